"""Merging, densities, windows and neighbour counts against their definitions, in crowded fields and long series."""

import logging
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import dedup, density, lightcurve

SEC = 1 / 3600


def greedy(rows, radius):
    """rows: (id, rank, ra, dec) near the equator; member to owner, row by row."""
    order, owner = sorted(rows, key=lambda r: (r[1], r[0])), {}
    for n, (i, _, ra, dec) in enumerate(order):
        if i not in owner:
            owner[i] = i
            for j, _, ra2, dec2 in order[n + 1 :]:
                u, v = ([math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))] for a, d in ((ra, dec), (ra2, dec2)))
                if j not in owner and 2 * math.asin(min(1.0, math.dist(u, v) / 2)) * 206264.80624709636 <= radius:
                    owner[j] = i
    return owner


@pytest.mark.parametrize("seed,crowd", [(1, 20.0), (2, 6.0), (3, 2.0)])
def test_merging_a_crowded_field_is_greedy(spark, caplog, seed, crowd):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), (rng.uniform(-crowd, crowd) * SEC) % 360, rng.uniform(-crowd, crowd) * SEC) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, r int, ra double, dec double").repartition(4)
    with caplog.at_level(logging.INFO):
        got = {r.member: r.owner for r in dedup.merge_bands(df, "id", "r", 1.0).collect()}
    assert got == greedy(rows, 1.0) and "rounds" in caplog.text


def test_a_chain_of_rows_that_wait_for_each_other(spark):
    rows = [(i, i, i * 0.9 * SEC, 0.0) for i in range(17)] + [(100, 0, 50.0, 0.0)]
    got = {r.member: r.owner for r in dedup.merge_bands(spark.createDataFrame(rows, "id long, r int, ra double, dec double"), "id", "r", 1.0).collect()}
    assert got == greedy(rows, 1.0) and got[16] == 16 and got[15] == 14
    assert dedup.merge_bands(spark.createDataFrame([], "id long, r int, ra double, dec double"), "id", "r", 1.0).collect() == []


def test_few_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, "gr"[i % 2], (rng.gauss(0, 300) * SEC) % 360, rng.gauss(0, 300) * SEC) for i in range(600)] + [(1000, "g", 90.0, 89.999), (1001, "g", 270.0, 89.999), (1002, "g", 10.0, -90.0)]
    df = spark.createDataFrame(rows, "id long, band string, ra double, dec double")
    for radius, most in ((60.0, 5), (60.0, 1), (5.0, 2), (500.0, 40)):
        want = {r.id: r.n_neighbours <= most for r in dedup.neighbour_count(df, "id", radius, on=("band",)).collect()}
        assert {r.id: r.alone for r in dedup.few_neighbours(df, "id", radius, most, on=("band",)).collect()} == want and len(want) == len(rows)


def test_a_crowded_cell_makes_no_pairs(spark):
    df = spark.range(100_000).select("id", (10 + F.rand(1) * SEC).alias("ra"), (F.rand(2) * SEC).alias("dec"))
    began = time.time()
    assert dedup.few_neighbours(df, "id", 200.0).filter("not alone").count() == 100_000  # 10 ** 10 pairs otherwise
    assert time.time() - began < 60


@pytest.mark.parametrize("slope,noise,n", [(0.0, 1.0, 500), (0.9, 0.05, 2000), (-0.3, 0.5, 3)])
def test_densities_are_those_of_the_sum(spark, slope, noise, n):
    rng = np.random.default_rng(5)
    mag = rng.normal(18, 2, n)
    mag[0] = 40.0  # outside the grid
    d = slope * (mag - 18) + rng.normal(0, noise, n)
    rows = [("a", float(x), float(y)) for x, y in zip(mag, d)] + [("b", 18.0, 1.0), ("c", None, 1.0), (None, 18.0, 0.0), (None, 18.5, 0.5), (None, 18.0, 1.0)]
    got = density.kde2d_grid(spark.createDataFrame(rows, "g string, mag double, dmag double").repartition(5), ["g"]).filter("g = 'a'").collect()
    s = np.cov(mag, d) * n ** (-1 / 3)
    (x0, x1), (y0, y1), k = density.GRID
    x, y = np.linspace(x0, x1, k), np.linspace(y0, y1, k)
    at = np.stack(np.meshgrid(x, y, indexing="ij"), -1)[:, :, None] - np.stack([mag, d], -1)
    want = np.exp(-0.5 * np.einsum("ijna,ab,ijnb->ijn", at, np.linalg.inv(s), at)).sum(2) / (n * 2 * math.pi * math.sqrt(np.linalg.det(s)))
    have = np.zeros((k, k))
    for r in got:
        have[r.i, r.j] = r.density
        assert abs(r.x - x[r.i]) < 1e-9 and abs(r.y - y[r.j]) < 1e-9
    peak = 1 / (2 * math.pi * math.sqrt(np.linalg.det(s)))
    assert np.abs(have - want).max() < 3e-9 * peak and have.max() > 0
    assert {r.g for r in got} == {"a"}


def windows(times, width, closed):
    t0, out = None, []
    for t in sorted(times):
        if t0 is None or not (t <= t0 + width if closed else t < t0 + width):
            t0 = t
        out.append((t, t0))
    return sorted(out)


@pytest.mark.parametrize("closed", [False, True])
def test_windows_of_many_series(spark, monkeypatch, closed):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice("gr"), rng.randrange(400) / 8) for _ in range(3000)] + [(4, "g", None), (4, "g", float("nan")), (4, "g", 1.0), (5, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = lightcurve.anchored(spark.createDataFrame(rows, "s int, band string, jd double").repartition(3), ["s", "band"], 1.5, closed).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for key in {r[:2] for r in rows}:
        have = [(r.jd, r.t0) for r in got if (r.s, r.band) == key]
        known = [r[2] for r in rows if r[:2] == key and r[2] is not None and r[2] == r[2]]
        assert sorted(x for x in have if x[0] is not None) == windows(known, 1.5, closed)
        assert all(t0 is None for jd, t0 in have if jd is None)


def test_a_series_of_a_million_epochs(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("s"), (F.col("id") / 7).alias("jd"), F.lit(1.0).alias("flux"))
    began = time.time()
    out = lightcurve.anchored_windows(df, ["s"], 3.0).agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    assert (out.n, out.most) == (1_000_000, 21) and out.w == math.ceil(1_000_000 / 21) and time.time() - began < 60
