"""Catalogues in nested pixels of the sky, as partitions of a table that is written once and of which a search opens only what it needs.

Which pixels a circle or a box touches is found by descent: the twelve base pixels, then the four children of each
pixel that isn't clear of it, down to the order of the table; a pixel that lies inside is taken with all below it. Targets,
one or many, descend in batches within their tasks, so a search is one plan: the pixels (12 * 4 ** ORDER at most) are
broadcast and prune the partitions of the table while it runs.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.photometry import healpix_nested
from ..sources.files import there
from .dedup import shared_folder
from .spatial import in_box, radius_join, separation, unit, wider

#: Order of the pixels, and rows that a file of one has about.
ORDER, ROWS = 5, 2_000_000
#: Targets that descend at a time.
TARGETS = 256
#: Radians that rounding may be off by, and by how much more than its corners a pixel may reach out.
ROUND, EDGE = 1e-9, 1.01


def centres(pixel: np.ndarray, order: int) -> np.ndarray:
    """The unit vectors of nested pixels' centres, as rows.

    They come by the plane of Calabretta and Roukema (2007): base pixels are squares on their corners there, and from
    |y| = pi / 4 on lines of equal RA run together towards the poles.
    """
    n, quarter = 1 << order, math.pi / 4
    face, bits = pixel >> 2 * order, np.arange(order)
    u, v = (((((pixel[:, None] >> 2 * bits + k) & 1) << bits).sum(1) + 0.5) / n for k in (0, 1))
    row = face // 4
    x0, dx, y = (2 * (face % 4) + (row != 1)) * quarter, (u - v) * quarter, (u + v - row) * quarter
    squeeze = np.minimum(2.0 - np.abs(y) / quarter, 1.0)  # under 1 in the polar caps
    z = np.where(squeeze < 1.0, np.sign(y) * (1.0 - squeeze * squeeze / 3.0), y * (8.0 / (3.0 * math.pi)))
    phi, flat = x0 + dx / squeeze, np.sqrt(1.0 - z * z)
    return np.stack([flat * np.cos(phi), flat * np.sin(phi), z], 1)


def pixel_radius(order: int) -> float:
    """Radians from a pixel's centre within which all of it lies: from the centre of a pixel at z = 2/3 to its upper corner, the longest there is."""
    n = 1 << order
    z, corner, turn = 2 / 3, 1 - (1 - 1 / n) ** 2 / 3, math.pi / (4 * n)
    cosine = math.sqrt((1 - z * z) * (1 - corner * corner)) * math.cos(turn) + z * corner
    return EDGE * math.acos(min(1.0, cosine))


def _descent(n: int, place: Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(targets, first pixels, pixels of each range, whether they lie inside) for n targets.

    place(targets, vectors, r) says of circles of r radians whether a target touches them and whether they lie within it.
    """
    target, pixel = np.repeat(np.arange(n), 12), np.tile(np.arange(12), n)
    for k in range(order + 1):
        if k:
            target, pixel = np.repeat(target, 4), (pixel[:, None] * 4 + np.arange(4)).ravel()
        touches, within = place(target, centres(pixel, k), pixel_radius(k) + ROUND)
        size = 1 << 2 * (order - k)
        yield target[within], pixel[within] * size, size, True
        target, pixel = target[touches & ~within], pixel[touches & ~within]
    yield target, pixel, 1, False


def cover(targets: DataFrame, shape: list[str], place: Callable, order: int = ORDER) -> DataFrame:
    """targets with the ranges of pixels (lo to hi, at order) that they touch, and whether those lie inside.

    shape names columns of doubles that are dropped; place gets them as arrays, then what _descent says. Targets with a
    null or NaN among them touch nothing.
    """
    names = [c for c in targets.columns if c not in shape]
    schema = ", ".join([f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in names] + ["lo long", "hi long", "inside boolean"])

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), TARGETS):
                part = batch.slice(i, TARGETS)
                given = [part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in shape]
                known = np.flatnonzero(np.all([np.isfinite(x) for x in given], 0))
                columns = [x[known] for x in given]
                for target, lo, size, inside in _descent(len(known), lambda t, v, r: place([x[t] for x in columns], v, r), order):
                    if len(target):
                        rows = part.take(pa.array(known[target]))
                        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(lo), pa.array(lo + size - 1), pa.array(np.full(len(lo), inside))], [*names, "lo", "hi", "inside"])

    return targets.mapInArrow(run, schema)


def _in_circle(given, v, r):
    x, y, z, reach = given
    away = 2.0 * np.arcsin(np.minimum(np.sqrt(((np.stack([x, y, z], 1) - v) ** 2).sum(1)) / 2.0, 1.0))
    return away <= reach + r, away + r <= reach


def _in_box(given, v, r):
    low, high, middle, half = given
    d, flat, held = np.arcsin(np.clip(v[:, 2], -1.0, 1.0)), np.hypot(v[:, 0], v[:, 1]), math.sin(min(r, math.pi / 2))
    turn = np.abs(np.arctan2(v[:, 1] * np.cos(middle) - v[:, 0] * np.sin(middle), v[:, 0] * np.cos(middle) + v[:, 1] * np.sin(middle)))
    reach = np.where(flat > held, np.arcsin(np.minimum(held / np.maximum(flat, held), 1.0)), math.pi)  # of the circle in RA; all round if it holds a pole
    round_ = half >= math.pi
    touches = (d >= low - r) & (d <= high + r) & (round_ | (turn <= half + reach))
    return touches, (d >= low + r) & (d <= high - r) & (round_ | (turn + reach <= half))


def circle_cover(targets: DataFrame, radius: Column | float, ra: str = "ra", dec: str = "dec", order: int = ORDER) -> DataFrame:
    """cover() of circles of `radius` arc seconds around ra and dec."""
    v = dict(zip(("_x", "_y", "_z"), unit(F.col(ra), F.col(dec))))
    v["_reach"] = F.radians((radius if isinstance(radius, Column) else F.lit(float(radius))) / 3600.0)
    return cover(targets.withColumns(v), list(v), _in_circle, order)


def box_cover(spark: SparkSession, ra: tuple[float, float], dec: tuple[float, float], buffer: float = 0.0, on_sky: bool = False, order: int = ORDER) -> DataFrame:
    """cover() of one box, widened as spatial.wider() says."""
    ends, (low, high) = wider(ra, dec, buffer, on_sky)
    half = 180.0 if ends is None else (ends[1] - ends[0]) % 360.0 / 2
    middle = 0.0 if ends is None else ends[0] + half
    shape = ["_low", "_high", "_middle", "_half"]
    box = spark.createDataFrame([tuple(math.radians(x) for x in (max(-90.0, low), min(90.0, high), middle, half))], ", ".join(f"{c} double" for c in shape))
    return cover(box, shape, _in_box, order)


def pixels(ranges: DataFrame) -> DataFrame:
    """hpix, once for each pixel of the ranges (lo, hi)."""
    every = ranges.select("lo", "hi").filter("lo <= hi").distinct().select(F.explode(F.sequence("lo", "hi")).alias("hpix"))
    return every.select(F.col("hpix").cast("int").alias("hpix")).distinct()


def by_pixel(df: DataFrame, ra: str = "ra", dec: str = "dec", path: str | None = None, order: int = ORDER) -> DataFrame:
    """df as a table whose partitions are nested pixels (hpix), written to path, or to a new folder, and read again."""
    path = path or f"{shared_folder(df.sparkSession)}/pixels-{uuid.uuid4().hex}"
    cells = df.withColumn("hpix", healpix_nested(F.col(ra), F.col(dec), order).cast("int"))
    # a key that can't be NULL: else Spark works the pixel out once more, to leave out NULLs, and far more slowly there
    crowd = cells.groupBy(F.coalesce("hpix", F.lit(-1)).alias("hpix")).agg((F.count(F.lit(1)) / ROWS + 1).cast("long").alias("_n"))  # a row a pixel
    part = F.pmod(F.xxhash64(ra, dec), F.col("_n"))  # a crowded pixel is written by several tasks
    cells.join(F.broadcast(crowd), "hpix", "left").repartition("hpix", part).select(*cells.columns).write.partitionBy("hpix").parquet(path)
    return _opened(df, path, order)


def _opened(df: DataFrame, path: str, order: int) -> DataFrame:
    """The table at path; the field hpix carries the order of its pixels."""
    table = df.sparkSession.read.schema(df.withColumn("hpix", F.lit(0)).schema).parquet(path)
    return table.withMetadata("hpix", {"order": order})


def order_of(table: DataFrame) -> int:
    return table.schema["hpix"].metadata.get("order", ORDER)


def _inputs(df: DataFrame) -> str:
    """A name for the files that df reads: their paths, sizes and times, and df's columns. Files are listed, not opened."""
    files = sorted(df.inputFiles())
    if not files:
        raise ValueError("a stored index needs a table that is read from files")
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    mark = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{tuple(mark)} {df.schema.simpleString()}"


def stored(df: DataFrame, name: str, ra: str = "ra", dec: str = "dec", folder: str | None = None, order: int = ORDER) -> DataFrame:
    """The by_pixel table of df that searches share: written where there is none yet for this name and these input files.

    name stands for how df is made of its files. A table is written under a name of its own and then renamed, so a
    broken write leaves none behind; changed files make a new one.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    path = f"{folder}/sky-{name}-{order}-{hashlib.sha256(f'{_inputs(df)} {ra} {dec}'.encode()).hexdigest()[:24]}"
    if not there(spark, f"{path}/_SUCCESS"):
        by_pixel(df, ra, dec, own := f"{path}.{uuid.uuid4().hex}", order)
        old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (own, path))
        fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
        if not there(spark, path):
            fs.rename(old, new)
        if not there(spark, f"{path}/_SUCCESS"):
            raise OSError(f"{own} can't become {path}")
    return _opened(df, path, order)


def only(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of a by_pixel table in the pixels of the ranges; Spark prunes the partitions by them while it runs."""
    return table.join(F.broadcast(pixels(ranges)), "hpix", "left_semi")


def cone(table: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Rows within radius arc seconds of a place, with sep."""
    target = table.sparkSession.createDataFrame([(float(ra), float(dec))], "ra double, dec double")
    return only(table, circle_cover(target, radius, order=order_of(table))).withColumn("sep", separation(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec"))).filter(F.col("sep") <= radius)


def box(table: DataFrame, ra: tuple[float, float], dec: tuple[float, float], buffer: float = 0.0, on_sky: bool = False) -> DataFrame:
    """Rows in a box, widened as spatial.wider() says."""
    return only(table, box_cover(table.sparkSession, ra, dec, buffer, on_sky, order_of(table))).filter(in_box(ra, dec, buffer, on_sky))


def light_curves(table: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Pairs of targets (ra, dec) and rows of a by_pixel table (ra2, dec2) within radius arc seconds.

    Targets at one place have the same rows, so a place is looked up once, whatever targets share it.
    """
    return of_targets(place_curves(table, targets, radius), targets)


def place_curves(table: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """light_curves() of the targets' places (ra, dec), each once: what all targets of a place share is worked out here."""
    places = targets.select("ra", "dec").distinct()
    return radius_join(places, only(table, circle_cover(places, radius, order=order_of(table))), radius)


def of_targets(curves: DataFrame, targets: DataFrame) -> DataFrame:
    """place_curves() for each target at its place; the rows come out of this join and are not shuffled."""
    return curves.join(targets, ["ra", "dec"])
