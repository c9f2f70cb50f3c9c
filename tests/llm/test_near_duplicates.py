"""The exact join behind the Hamming index: no pair lost, and none made for texts that bounds or components keep apart."""

import random

import pytest

from meridian.llm import neardup


def frames(spark, sets, comps):
    entries = spark.createDataFrame([(rep, comps[rep]) for rep in sets], "rep long, comp long")
    return entries, spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>")


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_pairs_lose_no_similar_pair(spark, percent):
    rng = random.Random(percent)
    sets = {}
    for family in range(12):
        base = [family * 1000 + i for i in range(rng.choice([1, 5, 40, 41, 90]))]
        for _ in range(12):
            mine = [x for x in base if rng.random() > 0.08] + [10**6 + rng.randrange(10**9) for _ in range(rng.randrange(8))]
            if mine:
                sets[len(sets)] = mine
    comps = {rep: rng.randrange(len(sets)) for rep in sets}
    got = {tuple(sorted(r)) for r in neardup._prefix_pairs(*frames(spark, sets, comps), percent).collect()}
    assert all(comps[a] != comps[b] for a, b in got)
    for a in sets:
        for b in range(a + 1, len(sets)):
            both = len(set(sets[a]) & set(sets[b]))
            if comps[a] != comps[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in got


def test_copies_of_a_template_are_not_paired(spark, monkeypatch):
    """20,000 texts share 66 shingles; those with five own ones are one component, those with seven too far from all."""
    sets = {rep: list(range(66)) + [1000 + rep * 10 + i for i in range(5 + rep % 2 * 2)] for rep in range(20_000)}
    comps = {rep: rep if rep % 2 else 0 for rep in sets}
    made = {}

    def noted(df, name, write=neardup.written):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "written", noted)
    assert neardup._prefix_pairs(*frames(spark, sets, comps), 85).count() == 0
    assert made["meeting"] == 0 and made["prefixes"] > 20_000


def test_texts_of_a_template_match_brute_force(spark):
    rng = random.Random(3)
    template = [f"w{i}" for i in range(70)]
    texts = {i: template + [f"own{rng.randrange(10**9)}" for _ in range(5 + i % 3)] for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    sets = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == {i: find(i) for i in sets}
