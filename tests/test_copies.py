"""Queries on tables with many objects at one place: places repeat with keys that are 93,600 apart."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_catalogue import SF, TABLES, plain

from meridian import plans
from meridian.operators import dedup, density, spatial, tiles
from meridian.sources import quadrants, tables

PERIOD, COPIES = 93_600, 3
SHIFTED = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"], "events": ["user_id"]}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """A folder of the smallest tables, in which each object is three times at its place, and a database of them."""
    import duckdb

    folder, db = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for t in TABLES:
        keys = SHIFTED.get(t, [])
        more = ", event_id * 3 + i AS event_id" if t == "events" else ""
        rows = f"(SELECT * REPLACE ({', '.join(f'{k} + i * {PERIOD} AS {k}' for k in keys)}{more}) FROM '{SF}/{t}.parquet', range({COPIES}) r(i))" if keys else f"'{SF}/{t}.parquet'"
        db.execute(f"COPY (SELECT * {'EXCLUDE (i) ' if keys else ''}FROM {rows}) TO '{folder}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), db


def equals_sql(spark, copies, name):
    folder, db = copies
    got = plans.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    want = db.execute(plans.ORACLE[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    key = lambda r: [str(x) for x in r]
    have, should = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=key), sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert have == should and have


def test_objects_at_one_place_merge_their_own_bands(spark, copies):
    equals_sql(spark, copies, "merge_bands")


@pytest.mark.parametrize("name", ["fallback_match", "annulus_nn_join", "redshift_match", "carry_over_labels", "cone_multi_join", "coverage_flag", "proper_motion_filter", "full_outer_xmatch"])
def test_nearest_rows_where_many_share_a_place(spark, copies, name):
    equals_sql(spark, copies, name)


def test_light_curves_where_many_share_a_place(spark, copies):
    equals_sql(spark, copies, "lc_by_position")


def test_a_place_is_looked_up_once_for_all_its_targets_and_files(spark, monkeypatch, tmp_path):
    met = []
    whole = spatial.radius_join

    def counted(left, right, *args, **kwargs):
        met.append((left.count(), right.count(), set(left.columns) | set(right.columns)))
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(spatial, "radius_join", counted)
    hour, mag = F.array(F.lit(1.0)), F.array(F.lit(20.0))
    rows = spark.range(240).select(F.lit(3).alias("fieldid"), F.element_at(F.array(*map(F.lit, "gri")), (F.col("id") % 3 + 1).cast("int")).alias("band"), F.lit(7).alias("ccdid"), (F.floor(F.col("id") / 3) % 4 + 1).alias("qid"), F.lit(23).alias("release"), F.col("id").alias("objectid"), F.lit(10.0).alias("objra"), (F.floor(F.col("id") / 120) / 36000).alias("objdec"), hour.alias("hmjd"), mag.alias("mag"), mag.alias("magerr"), F.array(F.lit(0)).alias("catflags"))
    assert quadrants.write(rows, f"file://{tmp_path}/q") == 12
    boxes = spark.createDataFrame([(3, 9.0, 11.0, -1.0, 1.0), (4, 9.0, 11.0, -1.0, 1.0)], "fieldid long, ra_lo double, ra_hi double, dec_lo double, dec_hi double")
    some = spark.range(500).select("id", F.lit(10.0).alias("ra"), F.lit(0.0).alias("dec"))
    more = spark.createDataFrame([(7, 10.0, 0.0), (8, None, 0.0), (8, 10.0, 0.1 / 3600), (9, 10.0, 0.09 / 3600), (501, 10.0, 0.09 / 3600), (501, 10.0, 0.2 / 3600), (502, float("nan"), 0.0), (503, 10.0, None)], "id long, ra double, dec double")
    targets = some.union(more)
    found = [(r.id, r.path.rsplit("/", 1)[1], r.objectid) for r in quadrants.at_positions(spark, quadrants.catalogue(spark, f"file://{tmp_path}/q"), targets, boxes, 1.5, "id").collect()]
    # four places of two fields, and two places in each of twelve files; no path is carried along
    assert met[0][:2] == (8, 24) and not any("path" in x for x in met[0][2])
    # of ids with two places the nearer object, of equally near ones that with the smaller id
    first = {quadrants.FORM % (3, "gri"[i % 3], 7, i // 3 % 4 + 1, 23): i for i in range(12)}
    assert sorted(found) == sorted((i, f, o + 120 * (i == 501)) for i in [*range(500), 501] for f, o in first.items())


def test_a_place_meets_the_left_rows_once(spark, monkeypatch):
    met = []
    whole = spatial.radius_join

    def counted(left, right, *args, **kwargs):
        met.append(right.count())
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(spatial, "radius_join", counted)
    a = spark.range(2000).select(F.col("id").alias("i"), F.lit(10.0).alias("ra"), (F.col("id") % 2 * 2 / 3600.0).alias("dec"))
    b = spark.range(2000).select((1999 - F.col("id")).alias("j"), F.lit(10.0).alias("ra2"), ((F.col("id") % 2 * 2 + 0.25) / 3600.0).alias("dec2"), F.col("id").alias("note"))
    got = {(r.i, r.j, r.note) for r in spatial.nearest(a, b, 5.0, "i", "j").collect()}
    assert met == [2] and got == {(i, 1 - i % 2, 1998 if i % 2 == 0 else 1999) for i in range(2000)}


def test_neighbours_are_counted_by_cells(spark, monkeypatch):
    random.seed(4)
    places = [(random.choice([0.0, 359.999, 180.0]) + random.uniform(-0.02, 0.02), random.choice([89.99, -89.99, 0.0]) + random.uniform(-0.009, 0.009)) for _ in range(60)]
    rows = [(i, ("g", "r")[i % 2], *places[i % 60]) for i in range(600)] + [(600, "g", None, 0.0), (601, "g", float("nan"), 0.0)]
    df, met = spark.createDataFrame(rows, "id long, band string, ra double, dec double"), []
    whole = dedup.radius_join

    def counted(left, right, *args, **kwargs):
        met.append((left.count(), right.count()))
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(dedup, "radius_join", counted)
    got = {r.id: r.n_neighbours for r in dedup.neighbour_count(df, "id", 60.0, include_self=False, on=("band",)).collect()}
    assert max(met[0]) <= 60

    def sep(p, q):
        u, v = ([math.cos(math.radians(x[3])) * math.cos(math.radians(x[2])), math.cos(math.radians(x[3])) * math.sin(math.radians(x[2])), math.sin(math.radians(x[3]))] for x in (p, q))
        return 2 * math.asin(min(1.0, math.dist(u, v) / 2)) * 206264.80624709636
    assert got == {p[0]: sum(p[1] == q[1] and sep(p, q) <= 60.0 for q in rows[:600]) - 1 for p in rows[:600]}


def test_densities_add_up_rows_before_they_are_shuffled(spark):
    df = spark.range(200).select(F.lit("g").alias("band"), (16.0 + F.col("id") % 7).alias("mag"), (F.col("id") % 5 / 10.0).alias("dmag"), F.lit(0.1).alias("err"))
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = density.weighted_kde(df, [16.0, 18.0])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    assert "RoundRobinPartitioning" in density.kde_envelope(df.coalesce(1))._jdf.queryExecution().executedPlan().toString()


def test_rounding_settles_which_of_two_places_is_nearest_as_in_sql(spark):
    rng = random.Random(5)
    at = [(i, rng.uniform(0.0, 360.0), rng.uniform(-26.0, 26.0)) for i in range(3000)]
    left = spark.createDataFrame(at, "i long, ra double, dec double")
    right = spark.createDataFrame([(2 * i + (d > 0), ra, dec + d / 36000) for i, ra, dec in at for d in (-(i % 4 + 1), i % 4 + 1)], "j long, ra2 double, dec2 double")
    import duckdb

    db = duckdb.connect()
    db.register("l", left.toPandas())
    db.register("r", right.toPandas())
    sep = """2 * asin(sqrt(pow(cos(radians(l.dec)) * cos(radians(l.ra)) - cos(radians(r.dec2)) * cos(radians(r.ra2)), 2)
        + pow(cos(radians(l.dec)) * sin(radians(l.ra)) - cos(radians(r.dec2)) * sin(radians(r.ra2)), 2) + pow(sin(radians(l.dec)) - sin(radians(r.dec2)), 2)) / 2) * 648000 / pi()"""
    want = dict(db.execute(f"SELECT i, j FROM l JOIN r ON i = j // 2 QUALIFY row_number() OVER (PARTITION BY i ORDER BY {sep}, j) = 1").fetchall())
    assert {r.i: r.j for r in spatial.nearest(left, right, 2.0, "i", "j").collect()} == want
    # a thousandth of a second of arc further is further, whatever the step it lies in
    far = right.withColumn("dec2", F.when(F.col("j") % 2 == 0, F.col("dec2") - 0.001 / 3600).otherwise(F.col("dec2")))
    assert {r.i: r.j % 2 for r in spatial.nearest(left, far, 2.0, "i", "j").collect()} == dict.fromkeys(range(3000), 1)


def greedy_links(rows, radius):
    """rows: (id, rank, ra, dec); pairs (member, owner), row by row."""
    def unit(p):
        a, d = math.radians(p[2]), math.radians(p[3])
        return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)
    order, taken, links = sorted(rows, key=lambda r: (r[1], r[0])), set(), set()
    known = [(p, unit(p)) if None not in p and p[2] == p[2] else (p, None) for p in order]
    for n, (p, u) in enumerate(known):
        if p[0] not in taken:
            mine = {q[0] for q, v in known[n + 1 :] if u and v and 2 * math.asin(math.dist(u, v) / 2) * 206264.80624709636 <= radius}
            taken |= mine
            links |= {(i, p[0]) for i in mine | {p[0]}}
    return links


def test_rows_of_all_objects_at_a_place_merge(spark, copies):
    folder, db = copies
    rows = db.execute(f"{tables.with_clause()} SELECT src_id, band_rank, ra, dec, band FROM cat_a").fetchall()
    near = {}
    for r in rows:
        near.setdefault(r[2], []).append(r)  # other places are of another RA, or some seconds of arc away in declination
    bands, want = {r[0]: r[4] for r in rows}, {}
    for place in near.values():
        for member, owner in greedy_links([r[:4] for r in place], 0.25):
            want.setdefault(owner, []).append(bands[member])
    got = {r.owner: (r.n, r.bands) for r in plans.QUERIES["merge_bands"](spark, folder).collect()}
    assert got == {o: (len(b), ",".join(sorted(set(b)))) for o, b in want.items()} and max(n for n, _ in got.values()) > 3


def test_a_row_near_two_owners_is_linked_by_both(spark):
    rng, sec = random.Random(6), 1 / 3600
    spots = [((rng.uniform(-4.0, 4.0) * sec) % 360, rng.uniform(-4.0, 4.0) * sec) for _ in range(60)]
    rows = [(i, rng.randrange(3), *rng.choice(spots)) for i in range(300)] + [(300, 0, None, 0.0), (301, 0, float("nan"), 0.0), (302, 0, float("nan"), 0.0), (303, 1, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, r int, ra double, dec double")
    got = [(r.member, r.owner) for r in dedup.merge_links(df, "id", "r", 1.0).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy_links(rows, 1.0) and len(got) > len(rows)


def test_merging_meets_a_place_once(spark, monkeypatch):
    met = []
    whole = dedup.radius_join

    def counted(left, right, *args, **kwargs):
        met.append((left.count(), right.count()))
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(dedup, "radius_join", counted)
    df = spark.range(5000).select("id", F.lit(1).alias("r"), F.lit(10.0).alias("ra"), (F.col("id") % 2 / 3600.0).alias("dec"))
    got = {(r.member, r.owner) for r in dedup.merge_bands(df, "id", "r", 0.5).collect()}
    assert met == [(2, 2)] and got == {(i, i % 2) for i in range(5000)}


def test_radius_join_measures_a_pair_of_places_once(spark, copies, monkeypatch):
    met = []
    whole = spatial.radius_join

    def counted(left, right, *args, **kwargs):
        met.append((left.count(), right.count()))
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(spatial, "radius_join", counted)
    equals_sql(spark, copies, "radius_join")
    places = "SELECT count(*) FROM (SELECT DISTINCT ra, dec FROM {})"
    assert met == [tuple(copies[1].execute(tables.with_clause() + places.format(t)).fetchone()[0] for t in ("cat_a", "cat_b"))]


def test_rows_of_pairs_of_places(spark):
    a = spark.createDataFrame([(i, "gr"[i % 2], ra, 0.0) for i, ra in enumerate([10.0, 10.0, 10.0, 359.9999, -0.0, None, float("nan")])], "i long, band string, ra double, dec double")
    b = spark.createDataFrame([(i, "gr"[i % 2], ra, 0.0) for i, ra in enumerate([10.0, 10.0, 10.0001, 0.0, None, float("nan"), 0.0])], "j long, band string, ra2 double, dec2 double")
    for on in ((), ("band",)):
        right = b if on else b.drop("band")
        want = {(r.i, r.j, round(r.sep, 6)) for r in spatial.radius_join(a, right, 1.0, on=on).collect()}
        got = [(r.i, r.j, round(r.sep, 6)) for r in spatial.with_rows(spatial.place_pairs(a, right, 1.0, on=on), a, right, on=on).collect()]
        assert set(got) == want and len(got) == len(want) and want


@pytest.mark.parametrize("name,targets", [("neowise_lc", "SELECT ra, dec FROM stars"), ("cone_search_many", "SELECT ra, dec FROM pos WHERE qid = 1")])
def test_targets_at_one_place_are_looked_up_once(spark, copies, monkeypatch, name, targets):
    met = []
    whole = tiles.radius_join

    def counted(left, right, *args, **kwargs):
        met.append(left.count())
        return whole(left, right, *args, **kwargs)
    monkeypatch.setattr(tiles, "radius_join", counted)
    equals_sql(spark, copies, name)
    n, places = copies[1].execute(f"{tables.with_clause()} SELECT count(*), count(DISTINCT (ra, dec)) FROM ({targets})").fetchone()
    assert met == [places] and n == (COPIES * places if name == "neowise_lc" else places)


def test_light_curves_are_put_in_order_before_targets_are_joined(spark, copies):
    plan = plans.QUERIES["neowise_lc"](spark, copies[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Window ")  # from the top: pairs of targets and rows are not sorted


def test_rows_without_a_pixel_are_kept_and_no_filter_works_pixels_out(spark, tmp_path, monkeypatch):
    seen = []
    whole = tiles.F.broadcast

    def noted(df):
        seen.append(df)
        return whole(df)
    monkeypatch.setattr(tiles.F, "broadcast", noted)
    df = spark.range(50).select("id", F.when(F.col("id") != 3, F.col("id") * 7.0).alias("ra"), (F.col("id") - 30.0).alias("dec"))
    rows = tiles.by_pixel(df, path=f"file://{tmp_path}/pixels")
    assert not seen[0].schema["hpix"].nullable  # else the join on it infers a filter on the whole expression
    assert rows.count() == 50 and rows.filter("hpix is null").count() == 1
