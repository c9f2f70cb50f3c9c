"""Specs of surveys and what makes one series; stored envelopes; streams in any order and repeated batches."""

import datetime
import math
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meridian.operators import density, lightcurve, surveys
from meridian.plans.groups import CHAIN
from meridian.sources.tables import Tables
from meridian.streaming import jobs

SF = "/root/testdata/sf0.001"


def ztf(spark, rows):
    return spark.createDataFrame(rows, "source long, seq long, oid long, ra double, dec double, mjd double, filtercode string, mag double, magerr double, extra string")


def test_a_table_that_misses_a_column_is_an_error(spark):
    df = ztf(spark, [(1, 1, 5, 0.0, 0.0, 1.0, "zg", 20.0, 0.1, "")])
    assert surveys.compiled(df, surveys.SURVEYS["ztf"]).columns == ["source", "survey", "seq", "ztf_id", "ra", "dec", "mjd", "g_mag", "g_magerr", "r_mag", "r_magerr", "i_mag", "i_magerr"]
    with pytest.raises(ValueError, match="ztf: no column mag, oid"):
        surveys.compiled(df.drop("mag", "oid"), surveys.SURVEYS["ztf"])
    with pytest.raises(ValueError, match="not a number: mjd"):
        surveys.compiled(df.withColumn("mjd", F.lit("x")), surveys.SURVEYS["ztf"])


def test_missing_values_and_unknown_filters(spark):
    rows = [(1, 1, 5, 0.0, 0.0, 1.0, "zg", math.nan, 0.1, ""), (1, 2, 5, 0.0, 0.0, 2.0, "zr", math.inf, 0.1, ""), (1, 3, 5, 0.0, 0.0, math.nan, "zy", 20.0, None, ""), (1, 4, 5, 0.0, 0.0, 4.0, None, 20.0, 0.1, "")]
    got = surveys.compiled(ztf(spark, rows), surveys.SURVEYS["ztf"]).orderBy("seq").collect()
    assert all(r[f"{b}_mag"] is None for r in got for b in "gri") and got[2].mjd is None and got[0].g_magerr == 0.1 and got[0].r_magerr is None


def test_rows_of_one_object(spark):
    sec = 1 / 3600
    rows = [(1, i, i, (359.9999 + 0.0002 * (i % 2)) % 360, 0.0, 1.0, "zg", 20.0, 0.1, "") for i in range(10)] + [(1, 20, 99, 0.0, 5 * sec, 1.0, "zg", 20.0, 0.1, "")]
    spec = surveys.SURVEYS["ztf"]
    assert {r.seq for r in surveys.same_object(surveys.compiled(ztf(spark, rows), spec), spec).collect()} == set(range(10))
    custom = spark.createDataFrame([(1, 2, "b", 1.0, 1.0, 1.0, "g"), (1, 1, None, 1.0, 1.0, 1.0, "g"), (1, 3, None, 1.0, 1.0, 1.0, "g"), (2, 9, "c", 1.0, 1.0, 1.0, "g")], "source long, seq long, custom_id string, mjd double, custom_mag double, custom_magerr double, filter string")
    spec = surveys.SURVEYS["custom"]
    assert {r.seq for r in surveys.same_object(surveys.compiled(custom, spec), spec).collect()} == {1, 3, 9}


def test_nights_and_windows_keep_the_first_rows_place(spark):
    rows = [(1, s, 7, 10.0 + s, 0.0, t, f, m, 0.1, 0) for s, t, f, m in ((1, 1.0, 2, 20.0), (2, 1.5, 2, 21.0), (3, 1.2, 1, 18.0), (4, 2.5, 2, 22.0), (5, 1.1, 2, None))]
    df = spark.createDataFrame(rows, "source long, seq long, objID long, ra double, dec double, obsTime double, filterID int, mag double, magerr double, infoFlag2 int")
    got = surveys.assembled({"panstarrs": df}).orderBy("mjd").collect()
    assert [(r.panstarrs_id, r.ra, r.mjd, r.pstarr_g_mag, r.pstarr_r_mag) for r in got] == [(7, 13.0, 1.2, 18.0, None), (7, 11.0, 1.25, None, 20.5), (7, 14.0, 2.5, None, 22.0)]
    assert math.isclose(got[1].pstarr_r_magerr, math.sqrt(0.02) / 2) and "pstarr_z_mag" in got[0]
    empty = surveys.assembled({"panstarrs": df.limit(0), "ztf": ztf(spark, [])})
    assert empty.collect() == [] and empty.columns[:4] == ["source", "survey", "panstarrs_id", "ztf_id"]


def test_only_missing_envelopes_are_computed(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(f, b, rng.uniform(15, 20), rng.gauss(0, 0.3), 0.1) for f in (1, 2) for b in "gr" for _ in range(60)] + [(3, "g", 30.0, 0.0, 0.1)], "fieldid int, band string, mag double, dmag double, err double")
    path = f"file://{tmp_path}/envelopes"
    first = density.cached_envelopes(df.filter("band = 'g'"), path).collect()
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    both = density.cached_envelopes(df, path).collect()
    now = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    assert files.items() <= now.items() and {p.parts[-2] for p in now.keys() - files.keys()} == {"band=r"}
    assert set(first) <= set(both) and {(r.fieldid, r.band) for r in both} == {(1, "g"), (1, "r"), (2, "g"), (2, "r")}
    again = density.cached_envelopes(df, path).collect()
    assert set(again) == set(both) and now == {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    alone = density.kde_envelope(df.filter("fieldid = 1 and band = 'r'")).collect()
    assert {(r.c, round(r.d, 9), round(r.density, 9)) for r in alone} == {(r.c, round(r.d, 9), round(r.density, 9)) for r in both if (r.fieldid, r.band) == (1, "r")}


def test_windows_of_a_stream_in_any_order_are_those_of_the_batch(spark, tmp_path):
    rng, day0 = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = [(s, rng.randrange(0, 400) / 8) for s in (1, 2, 3) for _ in range(60)] + [(4, 0.0), (4, 3.0)]
    rows = [(s, 2460310.5 + d, float(i % 7), day0 + datetime.timedelta(days=d)) for i, (s, d) in enumerate(rows)]
    rng.shuffle(rows)
    schema = "s long, jd double, flux double, ts timestamp"
    for i in range(6):
        spark.createDataFrame(rows[i::6], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.createDataFrame([(9, 2470000.0, 0.0, day0 + datetime.timedelta(days=900))], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = jobs.anchored_windows(stream, ["s"], 3.0)
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.s, round(r.t0, 6), round(r.mean_jd, 6), round(r.mean_flux, 6), r.n)
    got = sorted(key(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = sorted(key(r) for r in lightcurve.anchored_windows(spark.createDataFrame(rows, schema), ["s"], 3.0).collect())
    assert got == want and len(got) > 20


def test_funnel_counts_stay_one_table_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    t = Tables(spark, SF)
    t.matched.repartition(6).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(t.matched.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    jobs.filter_funnel(stream, CHAIN, ["band"], out, checkpoint).awaitTermination()
    first = sorted(map(tuple, jobs.running_funnel(spark, out, ["band"]).collect()))
    tables = sorted(p.name for p in Path(tmp_path, "out/counts").iterdir())
    assert len(tables) == 2 and len(list(Path(tmp_path, "out/counts", tables[-1]).glob("*.parquet"))) == 1
    last = max(int(p.name) for p in Path(tmp_path, "c/commits").iterdir() if p.name.isdigit())
    for p in Path(tmp_path, "c/commits").iterdir():  # the last batch wasn't said to be done
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    jobs.filter_funnel(stream, CHAIN, ["band"], out, checkpoint).awaitTermination()
    assert sorted(map(tuple, jobs.running_funnel(spark, out, ["band"]).collect())) == first
    shutil.rmtree(Path(tmp_path, "out/counts", tables[-1]))  # a table that is gone falls back on the one before
    assert len(jobs._versions(spark, out)) == 1
