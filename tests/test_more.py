"""Later catalogue queries against their SQL; files and streams against the batch form."""

import math

import pytest
from pyspark.sql import functions as F
from test_catalogue import SF, db, plain  # noqa: F401

from meridian import plans
from meridian.operators import filters
from meridian.plans.groups import CHAIN
from meridian.sources import files
from meridian.sources.tables import Tables
from meridian.streaming import jobs

FP = "# Requested input R.A. = 10.5 degrees\n# Requested input Dec. = -3.25 degrees\nindex, jd, filter, flux,\n0 2460000.5 g 12.5\n1 2460001.5 r null\n"
KINDS = {"jd": "double", "filter": "string", "flux": "double"}


@pytest.mark.parametrize("name", ["kde2d_grid", "hdr_level", "absolute_mag", "cone_sorted", "funnel_order", "column_order", "fp_lookup", "lc_by_position", "calibration_stars", "survey_spec", "filter_branches", "scan_fp_text", "convert_format", "sink_extraction_json", "stream_window_stack", "stream_epoch_split", "neowise_lc", "weighted_kde", "kde_filter"])
def test_query_equals_sql(spark, db, name):  # noqa: F811
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(plans.ORACLE[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    key = lambda r: [str(x) for x in r]
    a, b = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=key), sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert a and a == b


def test_fp_text_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(FP)
    rows = files.scan_fp_text(spark, f"file://{tmp_path}/in", KINDS)
    assert [tuple(r)[1:] for r in rows.orderBy("jd").collect()] == [(10.5, -3.25, 2460000.5, "g", 12.5), (10.5, -3.25, 2460001.5, "r", None)]
    assert files.fp_index(spark, f"file://{tmp_path}/in").count() == 1
    files.sink_table(rows, f"file://{tmp_path}/out", ("filter",))
    assert files.scan_table(spark, f"file://{tmp_path}/out").count() == 2
    assert files.unseen(rows.select("path").distinct(), rows).count() == 0


def _drained(stream, tmp_path, mode):
    got = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.append(b.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return got


def test_streams_equal_batch(spark, tmp_path):
    e = Tables(spark, SF).epochs.withColumn("ts", F.timestamp_seconds((F.col("jd") - 2440587.5) * 86400.0))
    e.write.parquet(f"file://{tmp_path}/e")
    for i, job in enumerate((jobs.window_stack, jobs.epoch_split)):
        got = _drained(job(spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/e")), tmp_path / str(i), "complete")[-1]
        assert len(got) == job(e).count() > 0
    m = Tables(spark, SF).matched
    m.write.parquet(f"file://{tmp_path}/m")
    jobs.filter_funnel(spark.readStream.schema(m.schema).parquet(f"file://{tmp_path}/m"), CHAIN, ["band"], f"file://{tmp_path}/o", f"file://{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, jobs.running_funnel(spark, f"file://{tmp_path}/o", ["band"]).collect())) == sorted(map(tuple, filters.funnel(m, CHAIN, ["band"]).collect()))


def test_ingest_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / f"in/{n}.txt").write_text(FP)
    assert sum(map(len, _drained(jobs.fp_ingest(spark, f"file://{tmp_path}/in", KINDS), tmp_path, "append"))) == 2


def test_envelope_has_the_thousand_points_of_the_survey(spark):
    from meridian.operators import density

    rows = [("g", 18.0 + i / 100, 0.07 * i - 0.3, 0.05 + i / 200) for i in range(10)]
    grid = density.kde_envelope(spark.createDataFrame(rows, "band string, mag double, dmag double, err double")).filter("c = 18")
    got = sorted((r.d, r.density) for r in grid.collect())
    assert len(got) == 1000 and abs(got[1][0] - got[0][0] - 10 / 999) < 1e-9
    for d, value in got[::37]:
        want = sum(math.exp(-0.5 * ((d - x) / e) ** 2) / (e * math.sqrt(2 * math.pi)) for _, _, x, e in rows) / len(rows)
        assert abs(value - want) < 1e-9
