"""Text operators against brute force: every path, cut and window of small inputs."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import bpe, decontaminate, langid, mainhtml, quality, tokencounts, toxicity
from meridian.llm.alphabet import CODES, OTHER
from meridian.llm.queries import public_vocabulary


def path_cost(letters, price, cost):
    a = b = 0
    for ch in letters + " ":
        z = CODES.get(ch, OTHER if ch.isalpha() else 0)
        price += float(cost[a, b, z])
        a, b = b, z
    return price


@pytest.mark.parametrize("span", ["1d10t", "s t u p 1 d", "f00l", "a s.s", "heeeey", "y o  u f", "$tup!d", "n*b"])
def test_restored_text_is_the_cheapest_path(span):
    for seed in range(3):
        cost = np.random.default_rng(seed).random((64, 64, 64)).astype(np.float32) * 5
        every = [("".join(x for x, _ in way), sum(p for _, p in way)) for way in itertools.product(*toxicity.readings(span))]
        assert toxicity.restore(span, cost) == min(every, key=lambda x: path_cost(*x, cost))[0].strip()


def test_long_spans_cost_in_proportion():
    restorer = toxicity.Restorer(np.random.default_rng(1).random((64, 64, 64)).astype(np.float32))
    began = time.time()
    assert len(restorer.joined("a b c d " * 20_000)) > 60_000 and len(restorer.words("a1b" * 5_000)[0]) > 5_000
    assert time.time() - began < 60


@pytest.mark.parametrize("units", [95, 98, 99, 100, 104, 997])
def test_words_that_cross_any_unit_of_a_span_are_restored(units):
    cost = np.full((64, 64, 64), 5, np.float32)
    for x, y, z in zip("  stupid", " stupid ", "stupid s"):  # only this word is likely
        cost[CODES.get(x, 0), CODES.get(y, 0), CODES.get(z, 0)] = 0.1
    cost[:, :, CODES["x"]] = 1.0
    got = toxicity.Restorer(cost).joined(" ".join("x" * units + "stupid" + "x" * 7))
    assert "stupid" in got and got.count("x") == 7 + units


def test_spaced_out_insults_are_found(spark):
    plain = ["you are kind today", "what a stupid man", "an idiot like you", "a good friend of ours"]
    rows = [(i, " ".join([plain[i % 4]] * 3) + f" {i}") for i in range(80)]
    odd = {90: "what a s t u p i d man", 91: "an i d i o t like", 92: "a s-t-u-p-1-d man", 93: "a  s  t  u  p  i  d  man", 94: "a g o o d friend"}
    docs = spark.createDataFrame(rows + list(odd.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 in (1, 2))) for i in range(80)], "doc_id long, toxic int")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.scores(docs, labels, F.lit(True)).collect()}
    assert [got[i] for i in odd] == [True, True, True, True, False]


def brute_hits(text, items, size=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    w, hit, who = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - size + 1)) if v else ():
            win = v[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    who.add(str(item))
    return len(w), len(hit), len(who)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SHINGLES, 0])
def test_contamination_equals_brute_force(spark, broadcast):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d é F g".split()) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 11, 14]))) for i in range(12)] + [(0, None), (3, "a b c")]
    docs = [(i, text(rng.randrange(0, 60)) + " " + (rng.choice(items)[1] or "")) for i in range(40)] + [(7, "F a é"), (7, "zz"), (None, items[5][1]), (99, None)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast=broadcast)
    want = Counter((i, *brute_hits(t, items)) for i, t in docs)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == want


def quality_counts(t):
    w, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    g = Counter(zip(w, w[1:], w[2:]))
    repeat = len({j + k for j in range(len(w) - 2) if g[tuple(w[j : j + 3])] > 1 for k in range(3)})
    c = {"symbol_ratio": (sum(x in "#*$%&|<>" for x in t), len(w)), "dup_line_ratio": (len(lines) - len(set(lines)), len(lines)), "repeat_ratio": (repeat, len(w)), "mean_word": (sum(map(len, w)), len(w))}
    return c, len(w) < 50 or 100 * repeat > 50 * len(w)


def quality_verdicts(rows):
    """For each of rows (text, lang, source): the counts, whether the base rules fail it, and whether it is kept."""
    counts = [(*quality_counts(t or ""), (lang, source)) for t, lang, source in rows]
    groups = defaultdict(list)
    for c, failed, group in counts:
        if not failed:
            groups[group].append(c)

    def quantile(rows, k, p):
        v = sorted(c[k][0] / c[k][1] if k == "mean_word" else (c[k][0] + 1) / (c[k][1] + 1) for c in rows)
        return v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]

    def blended(group, k, p):
        lang = [c for g, rows in groups.items() if g[0] == group[0] for c in rows]
        whole = [c for rows in groups.values() for c in rows]
        q = (len(lang) * quantile(lang, k, p) + 100 * quantile(whole, k, p)) / (len(lang) + 100)
        return (len(groups[group]) * quantile(groups[group], k, p) + 100 * q) / (len(groups[group]) + 100)

    out = []
    for c, failed, group in counts:
        good = not failed
        if good:
            for k, (near, tail, spread) in quality.SPREADS.items():
                mid, far = blended(group, k, 0.5), spread * (blended(group, k, tail) - blended(group, k, near))
                x = c[k][0] / c[k][1] if k == "mean_word" else (c[k][0] - 3 * math.sqrt(c[k][0])) / c[k][1]
                good &= x <= mid + far and (k != "mean_word" or x >= mid - far)
        out.append((c, failed, good))
    return out


def some_quality_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, None)])
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(40, 90))]
        if i % 11 == 0:
            words = [w + "##" for w in words]
        if i % 13 == 0:
            words = [w[:1] for w in words]
        rows.append((" ".join(words[:30]) + "\n" + " ".join(words[30:]) + "\nsame line\nsame line" * (i % 3), lang, source))
    return rows


def test_fences_and_verdicts_equal_brute_force(spark):
    rows = [*some_quality_rows(2, 240), (None, "en", "a"), ("", None, "b")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, (c, failed, good) in enumerate(quality_verdicts(rows)):
        r = got[i]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.word_chars) == (c["symbol_ratio"][0], c["dup_line_ratio"][0], c["repeat_ratio"][0], c["mean_word"][0])
        assert (r.base_failed, r.kept) == (failed, good)
    assert not got[240].kept and got[240].n_words == 0 and 0 < sum(r.kept for r in got.values()) < 230


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(9)
    rows = some_quality_rows(7, 120)
    for i in range(12):  # near copies, exact copies, passages of the benchmark, insults
        t = rows[i * 3 + 1][0].split(" ")
        rows.append((" ".join([*t[:-2], "changed", "end"]), "en", "a"))
        rows.append((rows[i * 3 + 2][0], "de", "a"))
        rows.append((rows[i * 3 + 2][0] + f" tail {i} of the other text", "en", "b"))
    items = [(k, " ".join(rows[k * 7 + 4][0].split()[5:20])) for k in range(6)] + [(9, None)]
    toxic = {i for i in range(len(rows)) if rng.random() < 0.2}
    rows = [((t + f" you {rng.choice(['stupid', '1d10t', 's t u p i d'])} man") if i in toxic else t, lang, source) for i, (t, lang, source) in enumerate(rows)]
    rows += [(None, None, None), ("", "en", "a")]
    ids = rng.sample(range(1000), len(rows))
    spark.createDataFrame([(i, *r) for i, r in zip(ids, rows)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(n in toxic)) for n, i in enumerate(ids)] + [(2000 + i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    first = corpus_pipeline.without_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    left = [(r.doc_id, r.text, r.lang, r.source) for r in first.collect()]
    assert {ids[n] for n in toxic}.isdisjoint(r[0] for r in left) and len(left) == len(rows) - len(toxic)
    left = [r for r, (_, _, good) in zip(left, quality_verdicts([r[1:] for r in left])) if good]
    sets = {}
    for i, t, *_ in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    home = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if home[a] != home[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                home[a] = home[b] = min(home[a], home[b])
        home = {i: home[h] for i, h in home.items()}
    left = [r for r in left if home[r[0]] == r[0]]
    want = {i: t for i, t, *_ in left if not brute_hits(t, items)[1]}
    lib = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    assert 20 < len(want) < len(rows) - 60


def test_kneser_ney_equals_brute_force(spark):
    texts = ["abba cab", "Cabba ba", "жаба баба"]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    table = langid.counts(docs)
    top = Counter()
    for t in texts:
        c = " " * 3 + t.lower() + " "
        c = [x for x in c]
        for i in range(3, len(c)):
            g = c[i - 3 : i + 1]
            for j in range(2, -1, -1):
                if g[j] == " ":
                    g[: j + 1] = [" "] * (j + 1)
                    break
            top["".join(g)] += 1
    assert {r.gram: r.n for r in table.collect()} == dict(top)
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(levels[1]) + 1)
        n = levels[k]
        one, two = (sum(x == m for x in n.values()) for m in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        mine = {g: x for g, x in n.items() if g[:-1] == gram[:-1]}
        if not mine:
            return p(gram[1:])
        total = sum(mine.values())
        return max(mine.get(gram, 0) - d, 0) / total + d * len(mine) / total * p(gram[1:])

    contexts = ("   ", "abb", "zzz")
    every = {*top, "   z", "abbz", "zzzz", " баж", *(ctx + x for ctx in contexts for x in levels[1])}
    asked = spark.createDataFrame([(None, g, 1) for g in sorted(every) + [ctx + "\0" for ctx in contexts]], "lang string, gram string, n long")
    got = {r.gram: r.p[0] for r in langid.estimates(table.union(asked), ["xx"]).collect()}
    assert {g: got[g] for g in every} == pytest.approx({g: p(g) for g in every})
    for ctx in contexts:
        assert sum(got[ctx + x] for x in [*levels[1], "\0"]) == pytest.approx(1)


def test_languages_do_not_depend_on_what_is_broadcast(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñç"
    langs = [f"l{i:02d}" for i in range(40)]
    voc = {lang: ["".join(rng.choices(rng.sample(letters, 9), k=rng.randrange(2, 8))) for _ in range(30)] for lang in langs}
    rows = [(i * 40 + j, " ".join(rng.choices(voc[lang], k=15)) + f" {rng.choice('жщю')}x", lang) for i in range(12) for j, lang in enumerate(langs)]
    docs = spark.createDataFrame([*rows, (None, "", None), (None, "жщ", None)], "doc_id long, text string, lang string")
    full, part, none = ({r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 3 != 1, hot_values=n).collect() if r.doc_id is not None} for n in (langid.HOT_VALUES, 40 * 200, 0))
    assert sum(full[i].lang_pred == lang for i, _, lang in rows) > 0.97 * len(rows)
    for other in (part, none):
        for i, r in full.items():
            assert (r.lang_pred, r.rejected) == (other[i].lang_pred, other[i].rejected)
            assert (r.entropy, r.score) == pytest.approx((other[i].entropy, other[i].score), rel=1e-5)


def test_languages_of_other_scripts_and_texts_without_letters(spark):
    rng = random.Random(1)
    voc = {"ru": "это был очень хороший день для нас".split(), "bg": "това беше много хубав ден за всички".split(), "el": "αυτή ήταν μια πολύ καλή μέρα".split(), "zh": "今天 是 很好 的 日子 我们".split()}
    rows = [(i * 4 + j, " ".join(rng.choices(w, k=12)), lang) for i in range(40) for j, (lang, w) in enumerate(voc.items())]
    rows += [(1000, "😀 😀😀", "ru"), (1001, "123 --", None), (1002, None, "el"), (1003, "", None), (1004, "день " * 50_000, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 3 != 1).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:160])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in range(1000, 1004)) and got[1004].lang_pred == "ru"


def test_cuts_are_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        price = lambda x: sum(max(o, 0) if not c else max(-o, 0) for o, c in zip(odds, x)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert price(mainhtml.min_cut(odds, edges)) == pytest.approx(min(map(price, itertools.product([False, True], repeat=n))))


def test_the_cut_overrules_costs_and_long_pages_are_linear():
    page = "<div>" + "<p>A longer paragraph of the text, with several words in it.</p>" * 2 + "<p><a href=x>Word</a></p>" + "<p>A longer paragraph of the text, with several words in it.</p>" * 2 + "</div>"
    found, parents = mainhtml.blocks(page)
    odds = mainhtml.block_odds(found, mainhtml.PRIOR)
    assert [o > 0 for o in odds] == [True, True, False, True, True] and all(mainhtml.labels(found, parents, odds))
    for odd in ("<a " * 300_000, '<a ">" ' * 150_000, "<script>" * 100_000, "<!-- " * 200_000, "<div>x " * 60_000 + "</p>" * 60_000, "</b" * 300_000):
        began = time.time()
        mainhtml.main_text(odd)
        assert time.time() - began < 20
    assert mainhtml.main_text("no markup & more") == "no markup & more"


def test_boilerplate_within_the_article_goes_and_short_parts_of_it_stay():
    model = mainhtml.PRIOR | {"long2": -2, "long3": -2, "long8": 2, "long9": 2, "p": 2, "li": -2, "stops0": -2, "stops4": 2}
    long = "A long sentence, of many words; it goes on and on, and then some more, until it ends at last. " * 3
    page = f"""<html><body><header><h1>My site</h1><p>All the news that fits.</p></header><div class="cookie-notice"><p>{long}</p></div><main><article class="post content"><header><h1>Title</h1></header><p>{long}</p><p>Yes.</p><ul><li>one</li><li>two</li></ul><p>{long}</p>
    <aside><p>{long} aside</p></aside><div class="share-buttons"><a href=x>Share</a></div><section class="comments"><article class="comment"><p>{long} comment</p></article></section></article></main><div class="sidebar"><p>{long}</p></div><form><p>{long}</p></form></body></html>"""
    assert mainhtml.main_text(page, model).split("\n\n") == ["Title", long.strip(), "Yes.", "one", "two", long.strip()]


def test_shapes_are_fitted_on_clear_blocks(spark):
    page = "<nav><li><a href=x>Home</a></li><li><a href=y>News</a></li></nav><article><p>A sentence, and more of it here.</p><p>Another sentence; it goes on.</p></article><div><p>Left, right and more words here.</p></div>"
    pages = spark.createDataFrame([(i, "u", page) for i in range(60)] + [(100, None, None), (None, "v", "")], "page_id long, url string, html string")
    model = mainhtml.fit(pages)
    assert model["li"] < -1 < 1 < model["p"] and model["links3"] < -1
    got = {r.page_id: r for r in mainhtml.extract(pages).collect()}
    assert len(got) == 62 and got[3].text.split("\n\n") == ["A sentence, and more of it here.", "Another sentence; it goes on.", "Left, right and more words here."] and got[100].n_chars == got[None].n_chars == 0


def test_bpe_equals_the_library_on_any_script(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    odd = ["I'm you'll don't 'S", "naïve façade ß İ", "日本語 текст עברית", "a b c　", "   lead  and   trail   ", "x<|endoftext|>y", "\n\n\t \r\n", "😀👩‍👩‍👧", "é", "9²½ 12345", "\x00\x1f\x7f"]
    odd += ["".join(rng.choice("aZé 9'ßж\n _-²日") for _ in range(40)) for _ in range(60)]
    lib = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), public_vocabulary("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(odd):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].decoded == lib.decode(want, skip_special_tokens=False)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    texts = ["Ünïted states", "", None, "don't <stop> it", "日本 text", "a" * 400, "same", "same"]
    got = {r.doc_id: r.n_tokens for r in tokencounts.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_vocabulary("word_bpe_49k.json")).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
