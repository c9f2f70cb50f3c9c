"""Clustering against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import centroids

def key():
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)


def brute(rows, size, k, rounds):
    """rows: (vec_id, vector); what cluster() returns, by the definition."""
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    at = [v for _, v in starts]
    if not at:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in ok:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(at)]
    got = [(i, *near(v)) for i, v in ok]
    inertia = {n: sum(d for _, d, m in got if m == n) for n in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, fits(d), fits(inertia[n]), fits(sum(inertia.values())), sha[n]) for i, d, n in got), key=repr)


def check(spark, rows, size, k=16, rounds=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").withColumn("_v", F.lit(1)).withColumn("distance", F.lit(2))
    got = centroids.cluster(df.repartition(3), key(), size=size, k=k, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, size, k, rounds)
    return got


def test_equal_to_brute_force_with_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) / 64 for _ in range(3)]) for i in range(120)]  # a coarse grid: many ties
    rows += [rows[7], rows[7], (7, [0.5, 0.5, 0.5]), (None, [0.1, 0.1, 0.1]), (200, None), (201, []), (202, [1.0, None, 1.0]), (203, [1.0, math.nan, 1.0]), (204, [math.inf, 0.0, 0.0]), (205, [1.0] * 4)]
    assert len(check(spark, rows, 3)) == 124


def test_a_third_of_the_rows_may_be_one_vector(spark):
    rng = random.Random(6)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(80)] + [(i, [0.25] * 8) for i in range(100, 140)], 8)


def test_equal_centroids_take_the_smaller_number(spark):
    got = check(spark, [(i, [1.0, 1.0]) for i in range(30)], 2)
    assert {r["cluster"] for r in got} == {0}


def test_large_components_are_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randrange(0, 9) for _ in range(4)]) for i in range(60)]
    check(spark, rows, 4)
    check(spark, rows + [(99, [1e15, 0.0, 0.0, 0.0])], 4)


def test_few_and_no_vectors(spark):
    assert len(check(spark, [(1, [0.5]), (2, [-0.5])], 1)) == 2
    assert check(spark, [(1, None), (None, [1.0])], 1) == [] and check(spark, [], 1) == []


@pytest.mark.parametrize("k", [1, 4, 5, 40, 300])
def test_tree_finds_the_nearest_and_opens_few_nodes(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-50, 50, (k, 3))
    tree = centroids.Tree(points.tolist())
    q = np.concatenate([rng.integers(-60, 60, (500, 3)), points[:50]])
    every = ((q[:, None] - points[None]) ** 2).sum(2)
    number, least = tree.nearest(q)
    assert (least == every.min(1)).all() and (number == every.argmin(1)).all()
    if k == 300:  # branch and bound leaves most of the distances out
        seen, real = [], centroids.squares
        centroids.squares = lambda rows, point: seen.append(len(rows)) or real(rows, point)
        try:
            tree.nearest(q)
        finally:
            centroids.squares = real
        assert sum(seen) < 0.5 * every.size
