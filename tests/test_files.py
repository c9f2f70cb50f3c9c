"""Files whose names say what they hold, tolerances over many sizes, spellings of missing values."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions.photometry import SENTINELS, normalised
from meridian.operators import spatial
from meridian.sources import files, quadrants

ROWS = "fieldid int, band string, ccdid int, qid int, release int, objectid long, objra double, objdec double, hmjd array<double>, mag array<double>, magerr array<double>, catflags array<int>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('q')}/files"
    rows = []
    for f in (3, 400, 123456):
        for b in "gri":
            for q in (1, 2):
                for i in range(3):
                    rows.append((f, b, 7, q, 23, f * 100 + "gri".index(b) * 10 + q * 3 + i, (f / 1000 + i / 100) % 360, 10.0 + q / 100, [2.0, 1.0, 3.0, 4.0], [20.0, 21.0, None, math.nan], [0.1, 0.2, 0.1, 0.1], [0, 0, 0, 0] if i else [0, 4096, 0, 0]))
    df = spark.createDataFrame(rows, ROWS)
    assert quadrants.write(df, folder) == 18
    Path(folder[7:], "notes.parquet").write_bytes(b"not one of them")
    return folder


def boxes(spark):
    return spark.createDataFrame([(f, f / 1000 % 360 - 0.5, f / 1000 % 360 + 0.5, 9.0, 11.0) for f in (3, 400)], "fieldid long, ra_lo double, ra_hi double, dec_lo double, dec_hi double")


def test_names_are_parsed_and_built(spark, folder):
    files = quadrants.catalogue(spark, folder)
    got = {tuple(r)[2:] for r in files.collect()}
    assert got == {(f, b, 7, q, 23) for f in (3, 400, 123456) for b in "gri" for q in (1, 2)} and all(r.length > 0 for r in files.collect())
    built = files.select("path", quadrants.name_of(*quadrants.KEYS).alias("n")).collect()
    assert all(r.path.endswith("/" + r.n) for r in built) and built[0].n.startswith("ztf_")


def test_a_position_opens_the_files_of_its_field_only(spark, folder):
    files = quadrants.catalogue(spark, folder)
    targets = spark.createDataFrame([(1, 0.4, 10.01), (2, 0.4 + 1.4 / 3600, 10.02), (3, 50.0, 10.0)], "id long, ra double, dec double")
    found = quadrants.at_positions(spark, files, targets, boxes(spark), 1.5, "id")
    inside = files.join(boxes(spark).filter("fieldid = 400"), "fieldid")
    plan = quadrants.opened(spark, inside)
    assert len(plan.inputFiles()) == 6 and all("ztf_000400_" in p for p in plan.inputFiles())
    rows = found.collect()
    # both fields hold a place at RA 0.4, but only files of field 400 have an object there
    assert {(r.id, r.objectid // 100) for r in rows} == {(1, 400), (2, 400)} and len(rows) == 6
    curves = quadrants.light_curves(spark, found, "id").collect()
    assert {(r.id, r.band, r.hmjd) for r in curves} == {(i, b, 2.0) for i in (1, 2) for b in "gri"}  # flagged, null and NaN epochs are out
    assert {c for c in quadrants.opened(spark, inside, ["objectid"]).columns} == {"path", "objectid", *quadrants.KEYS}


def test_objects_by_id_and_no_files(spark, folder):
    files = quadrants.catalogue(spark, folder)
    ids = spark.createDataFrame([(1, 12345604), (2, 5)], "id long, objectid long")
    curves = quadrants.light_curves(spark, quadrants.of_objects(spark, files, ids, "id"), "id").collect()
    assert [(r.id, r.objectid, r.band, r.hmjd) for r in sorted(curves, key=lambda r: r.hmjd)] == [(1, 12345604, "g", 1.0), (1, 12345604, "g", 2.0)]
    assert quadrants.opened(spark, files.filter("fieldid = 9")).collect() == []
    assert quadrants.write(spark.createDataFrame([], ROWS), folder + "2") == 0


@pytest.mark.parametrize("atol,rtol", [(1e-6, 1e-5), (1e-3, 0.0), (1e-12, 1e-2), (5.0, 1e-5)])
def test_tolerances_over_twelve_decades(spark, atol, rtol):
    rng = random.Random(7)
    a = [s * 10 ** rng.uniform(-6, 6) for _ in range(300) for s in (1, -1)] + [0.0, 0.0, atol]
    b = [x + rng.choice([-1.001, -0.999, -0.5, 0, 0.5, 0.999, 1.001, 3]) * (atol + rtol * abs(x)) for x in a]
    left = spark.createDataFrame(list(enumerate([*a, math.nan, None, math.inf])), "i long, a double")
    right = spark.createDataFrame(list(enumerate([*b, math.nan, None, math.inf])), "j long, b double")
    got = {(r.i, r.j) for r in spatial.within(left, right, {("a", "b"): (atol, rtol)}).collect()}
    x, y = np.array(a)[:, None], np.array(b)[None]
    want = set(map(tuple, np.argwhere(np.abs(x - y) <= atol + rtol * np.abs(y))))
    assert got == want and len(want) > 300


def test_spellings_of_missing_values(spark):
    df = spark.createDataFrame([(x, float("nan"), -999, False, [1]) for x in SENTINELS] + [("None", -9999.0, 5, True, [2]), (None, None, None, None, None), ("-99", 0.0, 0, True, [])], "t string, d double, i int, b boolean, a array<int>")
    got = normalised(df, ["t", "d", "i", "b"]).collect()
    assert all(tuple(r)[:4] == (None,) * 4 for r in got[: len(SENTINELS)]) and got[0].a == [1]
    assert [tuple(r)[:4] for r in got[len(SENTINELS) :]] == [("None", None, 5, True), (None,) * 4, ("-99", 0.0, 0, True)]
    assert normalised(df, ["t"]).filter(F.isnan("d")).count() == len(SENTINELS)


def test_small_files_share_a_fixed_number_of_folders(spark, tmp_path):
    from meridian.plans import flows
    from meridian.sources.tables import Tables

    folder = flows._drops(Tables(spark, "/root/testdata/sf0.01"))  # 150 sources
    names = files.listed(spark, folder)
    assert len(names) <= files.FOLDERS
    assert sum(len([n for n in files.listed(spark, f"{folder}/{p}") if n.startswith("source_id=")]) for p in names) == 150
    rows = [(k, i, f"{k} line {i}") for k in range(100) for i in range(12)]
    assert files.sink_texts(spark.createDataFrame(rows, "k long, i long, value string"), f"file://{tmp_path}/t", "k", "i", folders=8) == 100
    got = {r.value for r in spark.read.text(f"file://{tmp_path}/t/*", wholetext=True).collect()}
    assert got == {"".join(f"{k} line {i}\n" for i in range(12)) for k in range(100)}
