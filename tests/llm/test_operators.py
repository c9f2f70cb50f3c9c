"""Text operators against brute force, and with empty, null and repeated rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import bpe, ctw, decontaminate, langid, mainhtml, neardup, quality, sstable, tokencounts, toxicity
from meridian.llm.queries import public_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def some_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + f" end{seed}."


@pytest.fixture(scope="module")
def docs(spark):
    base = some_text(1, 120)
    rows = [(i, some_text(i, 60 + i), "en", "s", "x") for i in range(2, 22)]
    rows += [(30, base, "en", "s", "x"), (31, base, "en", "t", "x"), (32, base.replace("end1.", "changed"), None, None, "x"), (33, None, "en", None, None), (34, "", None, "s", None), (35, "  \n\t", "en", "s", None), (36, "one two", "en", "s", None), (37, "A" * 30_000, "en", "s", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates_match_brute_force(spark, docs):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert {k: len(v) for k, v in sets.items()} == {k: r.n_shingles for k, r in got.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: find(i) for i in sets} == {i: r.component_id for i, r in got.items()}
    assert got[31].component_id == 30 and got[32].component_id == 30 and got[33].kept and got[34].kept


def test_decontamination_counts_words_in_windows(spark, docs):
    inside = " ".join(some_text(5, 65).split()[10:25])
    items = spark.createDataFrame([(1, inside), (2, inside), (3, "one, two"), (4, None), (5, "never there at all in any of the texts given here")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[5].n_hit >= 15 and got[5].n_items == 2 and got[36].n_hit == 2 and got[36].n_items == 1
    assert not got[33].contaminated and got[33].n_words == 0 and len(got) == docs.count()
    empty = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(empty) == docs.count() and not any(r.contaminated for r in empty)


def test_quality_counts_match_brute_force(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        g = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (got[r.doc_id].n_words, got[r.doc_id].word_chars, got[r.doc_id].n_repeat_words) == (len(w), sum(map(len, w)), len(cover))


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encoded(docs, public_vocabulary("byte_bpe_50k.json")).collect()}
    for r in docs.collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == want and got[r.doc_id].decoded == (r.text or "")


def test_shards_round_trip_and_lookup(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    folder = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(docs, public_vocabulary("word_bpe_49k.json"), folder, shards=3)
    got = sorted(sstable.read_shards(manifest, folder).collect())
    start = 0
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    for r in got:
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    system, base = sstable.open_fs(folder)
    found = {}
    for row in manifest.collect():
        shard = sstable.Reader(system.open_input_file(f"{base}/{row.path}"))
        for i in [*want, 999]:
            ids = shard.get(sstable.key_of(i))
            if ids is not None:
                found[i] = ids.tolist()
    assert found == want


def test_token_counts_do_not_depend_on_blocks(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    names, end = tokencounts.write_tokens(docs, public_vocabulary("word_bpe_49k.json"), folder)
    one = sorted(tokencounts.document_lengths(names, folder, end).collect())
    assert one == sorted(tokencounts.document_lengths(names, folder, end, block_tokens=7).collect()) and len(one) == docs.count()


def test_context_tree_scores_are_probabilities(spark):
    docs = spark.createDataFrame([(i, "ab" * 40 if i % 2 else "ba" * 40) for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scores(docs, F.col("doc_id") < 30).collect()}
    assert got[50].score == got[51].score < 0 and got[50].n_tokens == 1 and got[35].score > got[35].n_bytes * -0.3
    counts = spark.createDataFrame([(int.from_bytes(b"\0\0\0\0" + bytes([x]), "big"), 0 if x else 5) for x in range(256)], "key long, n long")
    assert sum(10**r.value for r in ctw.gram_scores(counts).collect()) == pytest.approx(1)


def test_language_and_toxicity_on_small_tables(spark):
    rows = [(i, f"the cat and the dog number {i} are here with them", "en") for i in range(20)] + [(100 + i, f"der hund und die katze nummer {i} sind hier bei ihnen", "de") for i in range(20)] + [(200, None, None), (201, "12 34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 3 != 1).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40]) and got[200].lang_pred == got[201].lang_pred == "und"
    bad = spark.createDataFrame([(i, f"you are {'idiot' if i % 2 else 'friend'} number {i} and the same") for i in range(60)] + [(98, "an 1d10t again"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.scores(bad, labels, F.col("doc_id") < 50).collect()}
    assert score[55] >= 0.5 > score[54] and score[98] >= 0.5 > score[99]


def test_pages_keep_the_article_only():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  part<br>of it.<p>Second part of the text, long enough.</article><div class=comments><p>Nice article, thanks!</p></div><aside>Related</aside><footer>&copy; me</footer>"
    assert mainhtml.main_text(page) == "Title & more\n\nFirst part of it.\n\nSecond part of the text, long enough."
    assert mainhtml.main_text(None) == mainhtml.main_text("") == ""
    assert mainhtml.min_cut([3.0, -1.0, -5.0], [(0, 1, 2.0), (1, 2, 0.5)]) == [True, True, False]


def test_features_of_tokens_are_those_of_whole_texts():
    cost = np.random.default_rng(1).random((64, 64, 64)).astype(np.float32)
    restorer = toxicity.Restorer(cost)
    known = toxicity._known(restorer)
    letter = r"[^\W\d_]"

    def whole_text(text):
        low = toxicity.SIGNED.sub(lambda m: m[0][: m.start(1) - m.start()] + restorer.span[m[1]], restorer.joined(text))
        return re.sub(rf"{letter}*({letter})\1\1{letter}*", lambda m: restorer.span[m[0]], low)

    for text in ["a1b c.d.e ff", "  (fr33 h-e-l-l-o w0rd\x1cx1y", "goooood!!! l l l", "3e*e ßsİsss", "a\x85b1", "", None]:
        whole = {f for w in toxicity.WORD.findall(whole_text(text or "")) for f in toxicity.word_features(w)}
        assert set(toxicity._document_features([text], restorer, known)[0]) == whole


def test_lookup_by_hash_finds_each_key():
    keys = np.unique(np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000))
    look = ctw._Lookup(keys, np.arange(len(keys), dtype=float))
    assert (look(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    assert len(ctw._Lookup(keys[:0], np.zeros(0))(keys[:0])) == 0


def test_context_tree_of_six_bytes_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    text = lambda: bytes(rng.choice(list(b"abc"), 300)).decode() + "abcabcx" * 5
    rows = [(i, text(), i < 8) for i in range(10)] + [(10, "zzabcabcx", False), (11, "", False)]
    counts = {}
    for _, t, train in rows:
        full = b"\0" * 6 + t.encode()
        for i in range(6, len(full)):
            for k in range(7):
                for j in range(8):
                    if train:
                        counts.setdefault((full[i - k : i], full[i] >> (8 - j), j), [0, 0])[full[i] >> (7 - j) & 1] += 1
    below = {}
    for c, x, j in counts:
        if c:
            below.setdefault((c[1:], x, j), []).append((c, x, j))
    log_kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    pw = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        pe = log_kt(counts[node])
        pw[node] = pe if len(node[0]) == 6 else math.log(0.5) + np.logaddexp(pe, sum(pw[c] for c in below[node]))

    def logp(full, i):
        total = 0
        for j in range(8):
            p, a, b = 0.5, 0.0, 1.0
            for k in range(7):
                node = (full[i - k : i], full[i] >> (8 - j), j)
                if node not in counts:
                    break
                n0, n1 = counts[node]
                kt = (n1 + 0.5) / (n0 + n1 + 1)
                w = math.exp(math.log(0.5) + log_kt(counts[node]) - pw[node]) if k < 6 else 1.0
                p, a, b = a + b * kt, a + b * w * kt, b * (1 - w)
            total += math.log10(p if full[i] >> (7 - j) & 1 else 1 - p)
        return total

    ends = {}
    for _, t, train in rows:
        full = b"\0\0" + t.encode()
        for i in range(2, len(full) + 1):
            for k in range(3):
                if train:
                    ends.setdefault(full[i - k : i], [0, 0])[i == len(full)] += 1

    def end_weight(c):
        pe = log_kt(ends[c])
        return pe if len(c) == 2 else math.log(0.5) + np.logaddexp(pe, sum(end_weight(x) for x in ends if len(x) == len(c) + 1 and x.endswith(c)))

    def end_logp(full, i):
        p, a, b = 0.5, 0.0, 1.0
        for k in range(3):
            if (c := full[i - k : i]) not in ends:
                break
            kt = (ends[c][1] + 0.5) / (sum(ends[c]) + 1)
            w = math.exp(math.log(0.5) + log_kt(ends[c]) - end_weight(c)) if k < 2 else 1.0
            p, a, b = a + b * kt, a + b * w * kt, b * (1 - w)
        return math.log10(p if i == len(full) else 1 - p)

    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ctw.scores(docs, F.col("doc_id") < 8).collect()}
    for i, t, _ in rows:
        full = b"\0" * 6 + t.encode()
        assert got[i] == pytest.approx(sum(logp(full, x) for x in range(6, len(full))) + sum(end_logp(full, x) for x in range(6, len(full) + 1)), abs=2e-5)


def test_near_duplicates_of_the_pipeline_reach_down_to_four_fifths(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]  # 100 shingles
    at = {1: 0, 2: 9, 3: 12}  # replacing the last n words changes n shingles: (100 - n) / (100 + n)
    rows = [(i, " ".join(base[: 104 - n] + [f"x{i}y{j}" for j in range(n)]), "en", "s") for i, n in at.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs.filter("doc_id <> 3"), "").collect()} == {1}  # 91 / 109 = 0.835
    assert {r.doc_id for r in neardup.near_duplicates(docs.filter("doc_id <> 3"), percent=85).filter("kept").collect()} == {1, 2}
    assert {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs.filter("doc_id <> 2"), "").collect()} == {1, 3}  # 88 / 112 = 0.786


def test_near_duplicate_chunks_follow_the_threshold():
    assert neardup.layout(85) == (33, 17)
    for percent in (70, 75, 80, 85, 90):
        errors, chunks = neardup.layout(percent)
        tail = sum(math.comb(96, e) * (1 - percent / 100) ** e * (percent / 100) ** (96 - e) for e in range(errors + 1, 97))
        assert tail <= 1e-6 and errors // chunks <= 1
    with pytest.raises(ValueError):
        neardup.layout(40)
