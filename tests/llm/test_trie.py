"""The prefix trie against one that is built from sets of members."""

import hashlib
import random
import zlib

import pytest

from meridian.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, chars string, skel int, kind int"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (*y[:2], hashlib.sha256(f"{len(y[2])}:{y[2]}{y[3]}".encode()).digest()[:16]))] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    nodes = {}
    for c, p in made.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], set()).add(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: [k for k in nodes if len(k) == len(q) + 1 and k[: len(q)] == q]
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids(p)), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        same = rng.random() < 0.3
        for t in range(3 if same else rng.randrange(0, 9)):
            rows.append((c, rng.choice([None, t, t, t]), "user" if same else rng.choice(["user", "bot", None]), f"hot {t}" if same else rng.choice(["", None, "hä", "long " * t, f"own {c}"])))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (100, 2**40, "r", "x" * 100_000), (200, 0, "ab", "c"), (201, 0, "a", "bc")]
    return rows


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 4), (3, 16), (4, 40), (5, None)])
def test_equal_to_a_trie_of_sets(spark, seed, shards):
    rows = made_up(seed)
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, trie.rebuilt_trie(df.repartition(3), shards).collect()), key=repr) == brute(rows)


def test_equal_conversations_are_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(100 * c, t, "u", f"the same {t}") for c in range(90) for t in range(4)] + [(100 * c + 1, 0, "u", "other") for c in range(9)]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    assert sorted(map(tuple, trie.rebuilt_trie(df, 12).collect()), key=repr) == brute(rows)
    cuts = trie.splitters(trie.rebuilt(df, *_rule()), 12)
    assert len(cuts) == 11 and len({p for p, _ in cuts}) < 6


def _rule():
    from pyspark.sql import functions as F

    c = F.col("conv_id")
    return c - c % 100, F.crc32(c.cast("string")) % 6, 5


def test_long_conversations_and_short_skeletons(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON_BYTES", 16 * 8 * 3)  # three turns a splitter
    rows = [(100 * c, t, "u", f"{t if t < 40 else (t, c)}") for c in range(8) for t in range(50)] + [(1000, t, "u", str(t % 3)) for t in range(3000)]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    got = trie.rebuilt_trie(df, 8).collect()
    assert sum(r["n_convs"] for r in got if r["depth"] == 40) == 9 and max(r["depth"] for r in got) == 3000
    assert sorted(map(tuple, trie.rebuilt_trie(df.filter("conv_id < 1000"), 8).collect()), key=repr) == brute([r for r in rows if r[0] < 1000])


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    df = spark.range(200_000).selectExpr("7 conv_id", "id turn", "'u' role", "cast(id as string) text")
    assert trie.trie(trie.paths(df)).count() == 200_001


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.rebuilt_trie(df).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "gone")]
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)
    assert [tuple(r) for r in trie.rebuilt_trie(df).collect()] == brute(rows) and brute(rows)[0][1] == 0
