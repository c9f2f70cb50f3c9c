"""Density envelopes and outliers in (magnitude, difference) space. Grids are small tables that grow with bands only."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.files import there

LOW, HIGH = 0.0013498980316301035, 0.9986501019683699  # the normal distribution at -3 and 3
ONE = (0.15865525393145707, 0.8413447460685429)  # at -1 and 1
CENTRES = (14.0, 24.0, 0.25)
#: Deviations beyond which a row adds less than 1e-13 of its peak to a grid point and is left out there.
REACH = 8.0


def kde_envelope(df: DataFrame, points: int = 1000, half_width: float = 0.5) -> DataFrame:
    """(band, c, d, density): mean of N(dmag, err) over the rows within half_width of each magnitude centre.

    A row goes to its four centres or fewer. Each task adds its rows up on one grid for each band and centre and sends
    that, so what is shuffled doesn't grow with the rows. Centres with one row or none have no grid.
    """
    lo, hi, step = CENTRES
    n, width = int(round((hi - lo) / step)), 10.0 / (points - 1)
    x = -5.0 + np.arange(points) * width

    def add(batches):
        grids: dict[tuple[str, int], list] = {}
        for batch in batches:
            band = np.array(batch.column("band").to_pylist(), object)
            mag, d, e = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("mag", "dmag", "err"))
            first = np.ceil((mag - half_width - lo) / step).astype(int)
            for k in range(int(2 * half_width / step) + 1):
                ci = first + k
                near = (ci >= 0) & (ci < n) & (np.abs(mag - (lo + ci * step)) < half_width)
                for b in set(band[near]):
                    for c in np.unique(ci[near & (band == b)]):
                        at = np.flatnonzero(near & (band == b) & (ci == c))
                        grid = grids.setdefault((b, int(c)), [np.zeros(points), 0])
                        for i in range(0, len(at), 2048):
                            j = at[i : i + 2048, None]
                            grid[0] += (np.exp(-0.5 * ((x - d[j]) / e[j]) ** 2) / (e[j] * math.sqrt(2 * math.pi))).sum(0)
                        grid[1] += len(at)
        for (b, c), (total, rows) in grids.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * points), pa.array([c] * points, pa.int32()), pa.array(range(points), pa.int32()), pa.array(total), pa.array([rows] * points, pa.int64())], ["band", "ci", "di", "total", "rows"])

    known = df.select("band", F.col("mag").cast("double"), F.col("dmag").cast("double"), F.col("err").cast("double")).dropna()
    known = known.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)  # few bytes a row, but work on every grid point
    sums = known.mapInArrow(add, "band string, ci int, di int, total double, rows long").groupBy("band", "ci", "di").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    return sums.filter("rows > 1").select("band", (lo + F.col("ci") * step).alias("c"), (-5.0 + F.col("di") * width).alias("d"), (F.col("total") / F.col("rows")).alias("density"))


def envelope_percentiles(grid: DataFrame, least: float = LOW, most: float = HIGH) -> DataFrame:
    """(band, c, low, high): where the cumulative density passes the two percentiles, by linear interpolation."""
    w = Window.partitionBy("band", "c").orderBy("d")
    cum = grid.withColumn("cdf", F.sum("density").over(w) / F.sum("density").over(Window.partitionBy("band", "c")))
    cum = cum.withColumn("cdf0", F.lag("cdf").over(w)).withColumn("d0", F.lag("d").over(w))
    def at(p):
        inside = (F.col("cdf") >= p) & (F.coalesce("cdf0", F.lit(-1.0)) < p)
        return F.min(F.when(inside, F.coalesce(F.col("d0") + (F.col("d") - F.col("d0")) * (p - F.col("cdf0")) / (F.col("cdf") - F.col("cdf0")), F.col("d"))))
    return cum.groupBy("band", "c").agg(at(least).alias("low"), at(most).alias("high"))


def big_differences(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """df with low, high (interpolated over magnitude, the outermost centres holding beyond) and big: whether dmag lies outside.

    Between two centres both must have bounds, else nothing is big.
    """
    lo, hi, step = CENTRES
    n = int(round((hi - lo) / step))
    b = F.broadcast(bounds.withColumn("ci", F.round((F.col("c") - lo) / step).cast("int")))  # 40 rows a band
    place = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (F.col("mag") - lo) / step))
    i = F.least(F.floor(place), F.lit(n - 2)).cast("int")
    one, two = (b.select(F.col("band").alias(f"_b{k}"), F.col("ci").alias(f"_c{k}"), F.col("low").alias(f"l{k}"), F.col("high").alias(f"h{k}")) for k in (1, 2))
    j = df.withColumn("_t", place - i).withColumn("_i", i)
    j = j.join(one, (F.col("band") == F.col("_b1")) & (F.col("_i") == F.col("_c1")), "left").join(two, (F.col("band") == F.col("_b2")) & (F.col("_i") + 1 == F.col("_c2")), "left")
    def at(x):
        return F.when(F.col("_t") == 0, F.col(f"{x}1")).when(F.col("_t") == 1, F.col(f"{x}2")).otherwise(F.col(f"{x}1") + F.col("_t") * (F.col(f"{x}2") - F.col(f"{x}1")))
    j = j.withColumn("low", at("l")).withColumn("high", at("h"))
    return j.withColumn("big", F.coalesce((F.col("dmag") < F.col("low")) | (F.col("dmag") > F.col("high")), F.lit(False))).drop("_t", "_i", "_b1", "_c1", "_b2", "_c2", "l1", "h1", "l2", "h2")


def cached_envelopes(df: DataFrame, path: str, field: str = "fieldid") -> DataFrame:
    """(field, band, c, d, density): the envelopes of df's fields and bands out of the table at path.

    Only those that the table lacks are computed, and only their partitions are written; one without a grid leaves an
    empty mark, so that it isn't tried again.
    """
    spark = df.sparkSession
    schema = f"`{field}` {df.schema[field].dataType.simpleString()}, band string, c double, d double, density double"
    stored = lambda: spark.read.schema(schema).parquet(path)
    wanted = df.select(field, "band").dropna().distinct()
    missing = wanted.join(stored().select(field, "band").distinct(), [field, "band"], "left_anti") if there(spark, path) else wanted
    missing = missing.withColumn("_key", F.to_json(F.struct(field, "band")))
    if not missing.isEmpty():
        new = df.join(F.broadcast(missing), [field, "band"]).withColumn("band", F.col("_key"))
        found = missing.join(kde_envelope(new).withColumnRenamed("band", "_key"), "_key", "left").select(field, "band", "c", "d", "density")
        found.repartition(field, "band").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(field, "band").parquet(path)
    return stored().join(wanted, [field, "band"], "left_semi").filter("c is not null")


def weighted_kde(df: DataFrame, centres: list[float], bandwidth: float = 1.0, points: int = 21) -> DataFrame:
    """(band, c, d, density): Gaussian kernel density of dmag at magnitude c, rows weighted by exp(-((mag - c) / (bandwidth / 2)) ** 2 / 2).

    Silverman's rule gives the kernel from the effective number of rows. Tasks add rows up before anything is shuffled. Rows beyond 8 deviations, which weigh less than
    1e-13, are left out.
    """
    near = df.withColumn("c", F.explode(F.array(*map(F.lit, centres))))
    z = (F.col("mag") - F.col("c")) / (bandwidth / 2)
    near = near.filter(F.abs(z) <= REACH).select("band", "c", "dmag", F.exp(-0.5 * z * z).alias("w"))
    w, x = F.col("w"), F.col("dmag")
    s = near.groupBy("band", "c").agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), (F.sum(w * x) / F.sum(w)).alias("mu"))
    spread = near.join(F.broadcast(s), ["band", "c"]).groupBy("band", "c", "sw", "sw2").agg(F.sum(w * (x - F.col("mu")) * (x - F.col("mu"))).alias("ss"))  # a row a band and centre
    neff = F.col("sw") * F.col("sw") / F.col("sw2")
    var = F.col("ss") / F.col("sw") / (1 - 1 / neff) * F.pow(neff * 0.75, F.lit(-0.4))
    spread = spread.filter(neff > 1).select("band", "c", "sw", var.alias("var")).filter("var > 0")
    grid = [-5.0 + 10.0 * i / (points - 1) for i in range(points)]
    kernel = lambda d: w / F.col("sw") * F.exp(-0.5 * (d - x) * (d - x) / F.col("var")) / F.sqrt(2 * math.pi * F.col("var"))
    g = near.join(F.broadcast(spread), ["band", "c"]).groupBy("band", "c").agg(*[F.sum(kernel(F.lit(d))).alias(f"_{i}") for i, d in enumerate(grid)])
    return g.select("band", "c", F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_{i}").alias("density")) for i, d in enumerate(grid)])))


GRID = ((11.0, 25.0), (-5.0, 5.0), 100)


#: Side of a cell in deviations of the kernel, and terms of its series.
SIDE, TERMS = 0.5, 10
_MOMENTS = [(a, b) for a in range(TERMS) for b in range(TERMS - a)]


def _spread(cells: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The grid of one group from the moments of its cells."""
    (x0, x1), (y0, y1), n = GRID
    dx, dy = (x1 - x0) / (n - 1), (y1 - y0) / (n - 1)
    one = cells.iloc[0]
    moments = np.zeros((len(cells), TERMS, TERMS))
    for a, b in _MOMENTS:
        moments[:, a, b] = cells[f"m{a}_{b}"] / (math.factorial(a) * math.factorial(b))
    middle = (cells[["c1", "c2"]].to_numpy(float) + 0.5) * SIDE

    def terms(d):
        """He_a(d) exp(-d * d / 2) for a < TERMS, along a last axis."""
        out = np.zeros((*d.shape, TERMS))
        out[..., 0] = np.exp(-0.5 * d * d)
        out[..., 1] = d * out[..., 0]
        for a in range(2, TERMS):
            out[..., a] = d * out[..., a - 1] - (a - 1) * out[..., a - 2]
        return out

    density = np.zeros((n, n))
    for i in range(n):
        u1 = i * dx / one["l11"]
        near = np.flatnonzero(np.abs(u1 - middle[:, 0]) <= REACH + SIDE)
        u2 = (np.arange(n) * dy - one["l21"] * u1) / one["l22"]
        for k in range(0, len(near), 1024):
            at = near[k : k + 1024]
            weights = np.einsum("cab,ca->cb", moments[at], terms(u1 - middle[at, 0]))
            density[i] += np.einsum("jcb,cb->j", terms(u2[:, None] - middle[at, 1]), weights)
    density /= one["_n"] * 2 * math.pi * one["l11"] * one["l22"]
    i, j = np.nonzero(density > 0)
    return pd.DataFrame({**{c: [one[c]] * len(i) for c in by}, "i": i, "j": j, "density": density[i, j]})


def kde2d_grid(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, x, y, density): Gaussian kernel density of (mag, dmag) on a fixed grid, Scott bandwidth.

    Where the kernel is round with deviation 1, rows are added up in cells of SIDE as moments, the coefficients of the
    kernel's series in Hermite functions about the cell's middle; so a row is seen once, tasks send a row a cell, and
    the grid comes from the cells of a group. What TERMS leave out is under 3e-9 of the kernel's peak a row, as
    t^TERMS / sqrt(TERMS!) is for t = SIDE / 2. Cells beyond REACH + SIDE deviations are left out, under 1e-13 of it.
    Points of no density aren't given. Groups of fewer than two rows, or on one line, give nothing.
    """
    (x0, x1), (y0, y1), n = GRID
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.var_samp("mag").alias("_xx"), F.var_samp("dmag").alias("_yy"), F.covar_samp("mag", "dmag").alias("_xy"))
    f2 = F.pow(F.col("_n").cast("double"), -1.0 / 3.0)
    s = s.select(*by, "_n", *[(F.col(v) * f2).alias(v) for v in ("_xx", "_yy", "_xy")]).filter("_xx * _yy - _xy * _xy > 0")
    root = F.sqrt("_xx")
    s = s.select(*by, "_n", root.alias("l11"), (F.col("_xy") / root).alias("l21"), F.sqrt(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")).alias("l22"))
    d = df.select(*by, "mag", "dmag").dropna(subset=["mag", "dmag"]).join(s, by).withColumn("_u1", (F.col("mag") - x0) / F.col("l11"))
    d = d.withColumn("_u2", (F.col("dmag") - y0 - F.col("l21") * F.col("_u1")) / F.col("l22"))
    d = d.withColumns({f"c{k}": F.floor(F.col(f"_u{k}") / SIDE) for k in (1, 2)})
    d = d.withColumns({f"_t{k}": F.col(f"_u{k}") - (F.col(f"c{k}") + 0.5) * SIDE for k in (1, 2)})
    for a in range(1, TERMS):
        d = d.withColumns({f"_p{k}_{a}": (F.col(f"_p{k}_{a - 1}") * F.col(f"_t{k}")) if a > 1 else F.col(f"_t{k}") for k in (1, 2)})
    term = lambda a, b: reduce(lambda x, y: x * y, [F.col(f"_p1_{a}")] * (a > 0) + [F.col(f"_p2_{b}")] * (b > 0), F.lit(1.0))
    cells = d.groupBy(*by, "_n", "l11", "l21", "l22", "c1", "c2").agg(*[F.sum(term(a, b)).alias(f"m{a}_{b}") for a, b in _MOMENTS])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    g = cells.groupBy(*by).applyInPandas(lambda pdf: _spread(pdf, by), f"{kinds}, i long, j long, density double")
    dx, dy = (x1 - x0) / (n - 1), (y1 - y0) / (n - 1)
    return g.select(*by, "i", "j", (x0 + F.col("i") * dx).alias("x"), (y0 + F.col("j") * dy).alias("y"), "density")


def hdr_level(grid: DataFrame, by: list[str], mass: float = 0.9973) -> DataFrame:
    """(by, level): the density down to which the densest grid points hold that share of the grid's sum."""
    w = Window.partitionBy(*by).orderBy(F.desc("density"))
    run = F.sum("density").over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = grid.withColumn("_c", run / F.sum("density").over(Window.partitionBy(*by)))
    return g.filter(F.col("_c") >= mass).groupBy(*by).agg(F.max("density").alias("level"))


def kde_filter(df: DataFrame, grid: DataFrame, level: DataFrame, by: list[str]) -> DataFrame:
    """df with score (bilinear density at mag, dmag; NULL outside the grid) and kept (score below the level)."""
    (x0, x1), (y0, y1), n = GRID
    at = {"i": ((F.col("mag") - x0) * (n - 1) / (x1 - x0)), "j": ((F.col("dmag") - y0) * (n - 1) / (y1 - y0))}
    out = df.withColumns({f"_{a}": F.floor(p) for a, p in at.items()} | {f"_t{a}": p - F.floor(p) for a, p in at.items()})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    corners = grid.select(*by, "i", "j", "density", around.alias("_c")).groupBy(*by, (F.col("i") - F.col("_c.a")).alias("_i"), (F.col("j") - F.col("_c.b")).alias("_j"))
    corners = corners.agg(*[F.max(F.when((F.col("_c.a") == a) & (F.col("_c.b") == b), F.col("density"))).alias(f"_p{a}{b}") for a in (0, 1) for b in (0, 1)])
    out = out.join(corners, [*by, "_i", "_j"], "left")  # broadcast while it is small, as Spark measures
    ti, tj = F.col("_ti"), F.col("_tj")
    p = {k: F.coalesce(f"_p{k}", F.lit(0.0)) for k in ("00", "01", "10", "11")}
    value = (1 - ti) * ((1 - tj) * p["00"] + tj * p["01"]) + ti * ((1 - tj) * p["10"] + tj * p["11"])
    inside = F.col("mag").between(x0, x1) & F.col("dmag").between(y0, y1)
    out = out.withColumn("score", F.when(inside, value)).join(level, by, "left")
    return out.withColumn("kept", F.coalesce(F.col("score") < F.col("level"), F.lit(False))).drop("_i", "_j", "_ti", "_tj", *[f"_p{k}" for k in p], "level")
