"""Registered catalogue queries against their SQL, spherical joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridian import plans
from meridian.operators import dedup, filters, lightcurve, ranking, spatial, tiles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["flux_to_mag", "shape_filter", "funnel_stats", "nn_join", "annulus_nn_join", "ivw_stack", "rolling_stack_days", "window3d_collapse", "n_bands", "near_mask", "snr_filter_both", "coverage_flag", "merge_bands", "dropout_attribution", "loss_breakdown", "footprint_join", "tolerance_match", "parallax_filter", "proper_motion_filter", "rank_by_dmag", "same_night_collapse", "envelope_percentile", "only_big_dmag"])
def test_query_equals_sql(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(plans.ORACLE[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    key = lambda r: [str(x) for x in r]
    assert sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=key) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)


def test_radius_join_at_the_seams(spark):
    random.seed(1)
    pts = [(i, random.choice([0.0001, 359.9999, 180.0, 10.0]) + random.uniform(-1e-3, 1e-3), random.choice([89.9999, -89.9999, 0.0, 45.0]) + random.uniform(-5e-5, 5e-5)) for i in range(200)]
    a = spark.createDataFrame([(i, ra % 360, max(-90.0, min(90.0, d))) for i, ra, d in pts], "i long, ra double, dec double")
    b = a.select(F.col("i").alias("j"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    rows = a.collect()

    def sep(p, q):
        u, v = ([math.cos(math.radians(x.dec)) * math.cos(math.radians(x.ra)), math.cos(math.radians(x.dec)) * math.sin(math.radians(x.ra)), math.sin(math.radians(x.dec))] for x in (p, q))
        return 2 * math.asin(math.dist(u, v) / 2) * 206264.80624709636
    want = {(p.i, q.i) for p in rows for q in rows if sep(p, q) <= 2.0}
    assert {(r.i, r.j) for r in spatial.radius_join(a, b, 2.0).collect()} == want


def test_greedy_merge_keeps_first_and_third_of_a_chain(spark):
    step = 0.8 / 3600
    df = spark.createDataFrame([(1, 1, 10.0, 0.0), (2, 1, 10.0, step), (3, 1, 10.0, 2 * step), (4, 2, 50.0, 0.0)], "id long, r int, ra double, dec double")
    assert {(r.member, r.owner) for r in dedup.merge_bands(df, "id", "r", 1.0).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_filters_split_all_rows(spark):
    row = "psf_flag int, sep_flag int, psf_mag double, kron_mag double, psf_err double, kron_err double, b_kron_mag double, b_kron_err double, a double, b double, npix long, mag double, magerr double, info_flag int, info_flag2 int, quality_flag int, obj_info_flag int, catalog_flag int, dec double"
    df = spark.createDataFrame([(None,) * 19, (0, 0, 18.0, 18.1, 0.0, 0.0, 18.0, 0.0, 1.0, 0.0, 10, 18.2, 0.0, 0, 0, 0, 0, 0, 1.0)], row)
    for f in filters.FILTERS.values():
        assert df.filter(f()).count() + df.filter(~f()).count() == 2


def test_boxes_and_fields_across_zero(spark):
    points = spark.createDataFrame([(1, 359.95, 0.0), (2, 0.05, 0.0), (3, 0.4, 0.0), (4, 180.0, 0.0), (5, 359.95, 3.0)], "i long, ra double, dec double")
    assert {r.i for r in points.filter(spatial.in_box((359.9, 0.1), (-1.0, 1.0))).collect()} == {1, 2}
    assert {r.i for r in points.filter(spatial.in_box((359.9, 0.1), (-1.0, 1.0), 0.5)).collect()} == {1, 2, 3}
    boxes = spark.createDataFrame([("a", 359.9, 360.1, -1.0, 1.0), ("b", 179.0, 181.0, -5.0, 5.0)], "f string, ra_lo double, ra_hi double, dec_lo double, dec_hi double")
    assert {(r.i, r.f) for r in spatial.in_ranges(points, boxes).collect()} == {(1, "a"), (2, "a"), (4, "b")}


def test_annulus_overwrites_columns_that_any_match_has(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0, 1.0, "x"), (2, 20.0, 0.0, 2.0, "y"), (3, 30.0, 0.0, 3.0, "z")], "i long, ra double, dec double, m double, note string")
    right = spark.createDataFrame([(7, 10.0, 2 / 3600, None, None), (8, 20.0, 2 / 3600, 9.0, None), (9, 30.0, 0.5 / 3600, 9.0, None)], "j long, ra2 double, dec2 double, m double, note string")
    got = {r.i: (r.j, r.m, r.note) for r in spatial.overwritten_match(left, right, 1.0, 3.0, "i", "j").collect()}
    assert got == {1: (7, None, "x"), 2: (8, 9.0, "y"), 3: (None, 3.0, "z")}


def test_ranks_over_many_partitions(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 1000) if i % 10 else None) for i in range(3000)], "i long, v double").repartition(7)
    got = [r.i for r in ranking.ranked(df, [F.desc_nulls_last("v"), F.asc("i")]).orderBy("rank").collect()]
    assert got == [r.i for r in df.orderBy(F.desc_nulls_last("v"), "i").collect()]


def test_funnels_of_different_filters_are_not_added(spark):
    f = spark.createDataFrame([(1, 1, "a", 3, 2), (2, 1, "b", 3, 2)], "field long, stage long, filter string, n_before long, n_after long")
    with pytest.raises(ValueError):
        filters.summed(f, "field")
    assert filters.summed(f.filter("field = 1"), "field").first().n_after == 2


def spatial_sep(r, ra, dec):
    u, v = ([math.cos(math.radians(d)) * math.cos(math.radians(a)), math.cos(math.radians(d)) * math.sin(math.radians(a)), math.sin(math.radians(d))] for a, d in ((r.ra, r.dec), (ra, dec)))
    return 2 * math.asin(min(1.0, math.dist(u, v) / 2)) * 206264.80624709636


def test_windows_and_nights_with_ties(spark):
    rows = [(1, t, i, 1.0, 2.0) for i, t in enumerate([0.0, 0.0, 0.5, 1.0, 1.2, 5.0])]
    df = spark.createDataFrame(rows, "s long, jd double, event_id long, flux double, flux_unc double")
    assert sorted((r.t0, r.n) for r in lightcurve.anchored_windows(df, ["s"], 1.0).collect()) == [(0.0, 3), (1.0, 2), (5.0, 1)]
    assert sorted((r.jd, r.n) for r in lightcurve.same_night(df, ["s"]).collect()) == [(0.0, 1), (0.5, 3), (1.2, 1), (5.0, 1)]
