"""Searches of the sky by pixels: nothing is lost at any width or place, and what is opened is pruned."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions.photometry import healpix_nested
from meridian.operators import spatial, tiles

N = 200_000


def even_sky():
    """(ra, dec) of N places that cover the sky evenly."""
    i = np.arange(N) + 0.5
    return np.degrees(i * math.pi * (3 - math.sqrt(5))) % 360, np.degrees(np.arcsin(1 - 2 * i / N))


@pytest.fixture(scope="module")
def sky(spark, tmp_path_factory):
    """The even sky as a table of pixels of order 3."""
    ra, dec = even_sky()
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(N), "ra": ra, "dec": dec}))
    return tiles.by_pixel(df, path=f"file://{tmp_path_factory.mktemp('sky')}/p", order=3)


def away(ra, dec):
    a, d = (np.radians(x) for x in even_sky())
    u = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])
    v = [math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec))]
    return np.degrees(2 * np.arcsin(np.minimum(np.linalg.norm(u.T - v, axis=1) / 2, 1)))


def covered(ranges):
    return np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges] or [np.array([], int)])


@pytest.fixture(scope="module")
def pixel_of(spark, sky):
    rows = sky.select("i", "hpix", healpix_nested(F.col("ra"), F.col("dec"), 5).alias("p")).toPandas().sort_values("i")
    return rows["p"].to_numpy(), rows["hpix"].to_numpy()


def test_centres_and_radii(spark):
    for order in (0, 1, 4):
        v = tiles.centres(np.arange(12 * 4**order), order)
        df = spark.createDataFrame([(i, float(np.degrees(np.arctan2(y, x)) % 360), float(np.degrees(np.arcsin(z)))) for i, (x, y, z) in enumerate(v)], "i long, ra double, dec double")
        assert df.filter(healpix_nested(F.col("ra"), F.col("dec"), order) != F.col("i")).count() == 0


def test_every_place_is_within_its_pixels_radius(pixel_of):
    a, d = (np.radians(x) for x in even_sky())
    u = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    far = 2 * np.arcsin(np.linalg.norm(u - tiles.centres(pixel_of[0], 5), axis=1) / 2)
    assert 0.95 < far.max() / tiles.pixel_radius(5) < 1


@pytest.mark.parametrize("ra,dec", [(0.0, 0.0), (359.9, -45.0), (123.0, 90.0), (77.0, -90.0), (10.0, 88.0), (45.0, 41.8)])
@pytest.mark.parametrize("radius", [0.0, 0.001, 0.5, 2.0, 20.0, 40.0, 90.0, 179.0, 180.0])
def test_circles_of_any_width_lose_no_row(spark, pixel_of, ra, dec, radius):
    one = spark.createDataFrame([(7, ra, dec)], "id long, ra double, dec double")
    ranges = tiles.circle_cover(one, radius * 3600).collect()
    found, sep = covered(ranges), away(ra, dec)
    assert len(set(found)) == len(found) and all(r["id"] == 7 for r in ranges)
    assert np.isin(pixel_of[0][sep <= radius], found).all()
    inside = covered([r for r in ranges if r["inside"]])
    assert (sep[np.isin(pixel_of[0], inside)] <= radius + 1e-6).all()
    assert not np.isin(pixel_of[0][sep > radius + 2 * math.degrees(tiles.pixel_radius(5)) + 1e-6], found).any()
    assert len(ranges) <= 4000


@pytest.mark.parametrize("ra,dec,radius", [(100.0, -10.0, 20.0), (0.0, 90.0, 40.0), (200.0, -90.0, 3.0), (359.0, 10.0, 179.0)])
def test_cones(sky, ra, dec, radius):
    got = np.array(sorted(r["i"] for r in tiles.cone(sky, ra, dec, radius * 3600).select("i").collect()))
    assert (got == np.flatnonzero(away(ra, dec) <= radius)).all()


BOXES = [
    ((0.0, 360.0), (-5.0, 5.0), 0.0, False), ((0.0, 359.9), (-5.0, 5.0), 0.2, False), ((350.0, 8.0), (-12.0, 9.0), 0.0, False), ((10.0, 20.0), (60.0, 90.0), 0.0, False),
    ((10.0, 350.0), (-90.0, -80.0), 1.0, False), ((0.0, 0.0), (-90.0, 90.0), 0.3, False), ((359.9, 0.1), (85.0, 86.0), 1.0, True), ((30.0, 31.0), (88.0, 89.5), 1.0, True), ((200.0, 10.0), (20.0, 21.0), 0.0, False), ((5.0, 365.0), (-91.0, 95.0), 0.0, False),
]


@pytest.mark.parametrize("ra,dec,buffer,on_sky", BOXES)
def test_boxes(spark, sky, pixel_of, ra, dec, buffer, on_sky):
    a, d = even_sky()
    width = ra[1] - ra[0] if ra[1] - ra[0] >= 360 else (ra[1] - ra[0]) % 360
    if on_sky:  # whoever is within the buffer of a place of the box, by a fine net of such places
        net = [(ra[0] + width * x / 12, dec[0] + (dec[1] - dec[0]) * y / 12) for x in range(13) for y in range(13)]
        want = np.zeros(N, bool)
        for place in net:
            want |= away(*place) <= buffer
    else:
        want = (d >= dec[0] - buffer) & (d <= dec[1] + buffer) & ((width + 2 * buffer >= 360) | ((a - ra[0] + buffer) % 360 <= width + 2 * buffer))
    found = covered(tiles.box_cover(spark, ra, dec, buffer, on_sky).collect())
    assert want.any() and np.isin(pixel_of[0][want], found).all()
    got = np.zeros(N, bool)
    got[[r["i"] for r in tiles.box(sky, ra, dec, buffer, on_sky).select("i").collect()]] = True
    assert (got >= want).all() if on_sky else (got == want).all()
    inside = covered(r for r in tiles.box_cover(spark, ra, dec, buffer, on_sky).collect() if r["inside"])
    assert got[np.isin(pixel_of[0], inside)].all()


def test_a_wider_box_on_the_sky_is_no_wider_than_its_reach():
    (lo, hi), _ = spatial.wider((10.0, 20.0), (60.0, 70.0), 1.0, True)
    assert math.isclose(hi - 20.0, math.degrees(math.asin(math.sin(math.radians(1)) / math.cos(math.radians(70))))) and math.isclose(lo, 30.0 - hi)
    assert spatial.wider((10.0, 20.0), (60.0, 89.5), 1.0, True)[0] is None


def test_many_targets_and_unknown_places(spark):
    rows = [(1, 10.0, 20.0, 5.0), (2, 10.0, 20.0, 3600.0), (3, None, 20.0, 5.0), (4, float("nan"), 2.0, 5.0), (5, 190.0, -89.0, 7200.0), (6, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows * 200, "id long, ra double, dec double, r double").repartition(3)
    got = tiles.circle_cover(df, F.col("r")).groupBy("id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).collect()
    one = {i: covered(tiles.circle_cover(df.filter(f"id = {i}").limit(1), F.col("r")).collect()).size for i in (1, 2, 5)}
    assert {r["id"]: r["n"] for r in got} == {i: 200 * n for i, n in one.items()}


def test_a_stored_table_is_written_once_and_pruned_while_the_search_runs(spark, tmp_path):
    ra, dec = (x[::100] for x in even_sky())
    base = f"file://{tmp_path}/base"
    spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "i long, ra double, dec double").write.parquet(base)
    shelf = Path(tmp_path, "shelf")
    shelf.mkdir()

    def search():
        table = tiles.stored(spark.read.parquet(base), "base", folder=f"file://{shelf}", order=2)
        found = tiles.cone(table, 100.0, -10.0, 36_000.0)
        return found, {r["i"] for r in found.collect()}

    found, first = search()
    files = {p: p.stat().st_mtime_ns for p in shelf.rglob("*")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    again = search()[1]
    assert first == again and len(first) > 10 and files == {p: p.stat().st_mtime_ns for p in shelf.rglob("*")} and len(list(shelf.iterdir())) == 1
    read = [m for m in plan.split("\n") if "PartitionFilters" in m]
    assert read and "hpix" in read[0]
    spark.createDataFrame([(99_999, 100.0, -10.0)], "i long, ra double, dec double").write.mode("append").parquet(base)
    assert search()[1] == first | {99_999} and len(list(shelf.iterdir())) == 2
