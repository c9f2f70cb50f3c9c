"""Joins on the sphere and in pixel space by hashed cells: equi-joins that shuffle or broadcast like any other.

A position is a unit vector in a cube grid whose cells are several radii wide. The right side is entered in every
cell that its radius touches (about two on average), so each pair within the radius meets exactly once. There is no special case at
RA 0/360 or at the poles.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ARCSEC = 180.0 * 3600.0 / math.pi
WIDE = 8.0
#: Arc seconds by which separations that differ in rounding alone may be apart, and much more.
ROUNDING = 1e-6


def unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Arc seconds between two positions."""
    d2 = sum((p - q) * (p - q) for p, q in zip(unit(ra1, dec1), unit(ra2, dec2)))
    return 2.0 * F.asin(F.least(F.sqrt(d2) / 2.0, F.lit(1.0))) * ARCSEC


def in_c(ra1: float, dec1: float, ra2: float, dec2: float) -> float:
    """separation() of two places with the C library's functions, each step rounded as SQL engines built on it round."""
    (a, b), (d, e) = (tuple(map(math.radians, x)) for x in ((ra1, ra2), (dec1, dec2)))
    d2 = math.pow(math.cos(d) * math.cos(a) - math.cos(e) * math.cos(b), 2) + math.pow(math.cos(d) * math.sin(a) - math.cos(e) * math.sin(b), 2) + math.pow(math.sin(d) - math.sin(e), 2)
    return 2 * math.asin(min(math.sqrt(d2) / 2, 1.0)) * 648000 / math.pi


@F.pandas_udf(DoubleType())
def _in_c(ra1: pd.Series, dec1: pd.Series, ra2: pd.Series, dec2: pd.Series) -> pd.Series:
    return pd.Series([in_c(*p) for p in zip(ra1, dec1, ra2, dec2)], dtype="float64")


def wider(ra: tuple[float, float], dec: tuple[float, float], buffer: float = 0.0, on_sky: bool = False) -> tuple[tuple[float, float] | None, tuple[float, float]]:
    """A box widened by buffer degrees of each coordinate or, on_sky, by so many degrees of arc: (ra, dec), ra None if it goes round.

    A box goes from its first RA upwards, through 0 where it starts above its end, and round if its ends are 360 or more apart.
    """
    low, high = dec[0] - buffer, dec[1] + buffer
    width, reach = ra[1] - ra[0], buffer
    width = width if width >= 360.0 else width % 360.0
    if on_sky and buffer > 0:  # a circle at declination d reaches asin(sin(buffer) / cos(d)) in RA, all round if it holds a pole
        far = max(abs(dec[0]), abs(dec[1]))
        reach = math.degrees(math.asin(min(1.0, math.sin(math.radians(buffer)) / math.cos(math.radians(far))))) if far + buffer < 90.0 else 360.0
    return None if width + 2 * reach >= 360.0 else ((ra[0] - reach) % 360.0, (ra[0] + width + reach) % 360.0), (low, high)


def in_box(ra: tuple[float, float], dec: tuple[float, float], buffer: float = 0.0, on_sky: bool = False) -> Column:
    """Whether ra (0 to 360) and dec lie in a box, widened as wider() says."""
    ends, (low, high) = wider(ra, dec, buffer, on_sky)
    x, y = F.col("ra"), F.col("dec").between(low, high)
    if ends is None:
        return x.isNotNull() & y
    lo, hi = ends
    return (x.between(lo, hi) if lo <= hi else (x >= lo) | (x <= hi)) & y


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_pos=("ra", "dec"), right_pos=("ra2", "dec2"), on: tuple = (), how: str = "inner") -> DataFrame:
    """All pairs within `radius` arc seconds, with `sep`. Columns of the two sides must differ, but for those in `on`.

    Where only left rows are asked for (left_semi, left_anti), places on the right count once.
    """
    if how in ("left_semi", "left_anti"):
        right = right.select(*on, *right_pos).distinct()
    chord = 2.0 * math.sin(radius / ARCSEC / 2.0)
    side = WIDE * chord
    u, v = unit(F.col(left_pos[0]), F.col(left_pos[1])), unit(F.col(right_pos[0]), F.col(right_pos[1]))
    lc = left.select("*", *[u[i].alias(f"_u{i}") for i in range(3)], *[F.floor(u[i] / side).alias(f"_c{i}") for i in range(3)])
    rc = right.select("*", *[v[i].alias(f"_v{i}") for i in range(3)])
    for i in range(3):
        rc = rc.withColumn(f"_c{i}", F.explode(F.sequence(F.floor((F.col(f"_v{i}") - chord * 1.0001) / side), F.floor((F.col(f"_v{i}") + chord * 1.0001) / side))))
    keys = [*on, "_c0", "_c1", "_c2"]
    d2 = sum((F.col(f"_u{i}") - F.col(f"_v{i}")) * (F.col(f"_u{i}") - F.col(f"_v{i}")) for i in range(3))
    drop = [f"_{x}{i}" for x in "uvc" for i in range(3)]
    if how != "inner":
        l2, r2 = lc.alias("l"), rc.alias("r")
        cond = d2 <= chord * chord
        for k in keys:
            cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        return l2.join(r2, cond, how).drop(*drop)
    j = lc.join(rc, keys).withColumn("_d2", d2).filter(F.col("_d2") <= chord * chord)
    return j.withColumn("sep", 2.0 * F.asin(F.sqrt("_d2") / 2.0) * ARCSEC).drop("_d2", *drop)


def place_pairs(left: DataFrame, right: DataFrame, radius: float, left_pos=("ra", "dec"), right_pos=("ra2", "dec2"), on: tuple = ()) -> DataFrame:
    """on, left_pos, right_pos, sep: each place of the left with each of the right within the radius, once, whatever they hold."""
    return radius_join(left.select(*on, *left_pos).distinct(), right.select(*on, *right_pos).distinct(), radius, left_pos, right_pos, on)


def with_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, left_pos=("ra", "dec"), right_pos=("ra2", "dec2"), on: tuple = ()) -> DataFrame:
    """Each left row with each right row of these pairs of places, and the pairs' other columns.

    What depends on the places alone is best worked out in the pairs, as there may be many more rows. These are made by the
    last step, one left row at a time, and nothing of their number is shuffled or kept.
    """
    return left.join(pairs, [*on, *left_pos]).join(right, [*on, *right_pos])


def nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, on: tuple = (), left_pos=("ra", "dec"), right_pos=("ra2", "dec2"), per: tuple = ()) -> DataFrame:
    """For each left row with a neighbour within the radius: left_id, on, sep and all columns of the nearest right row; ties go to the smaller right_id.

    Of right rows at one place only the first can be nearest, so a place meets the left rows once, whatever it holds.
    With `per`, columns of the right side, it is the nearest for each of their values; left rows are not repeated for them.
    Where rounding alone says which of several places is nearest, as of two on either side, in_c() does: the JVM's sines
    and cosines differ from the C library's in the last bit of some 0.2 % of them.
    """
    others = [c for c in right.columns if c not in (*on, *per, right_id)]
    rest = [c for c in others if c not in right_pos]
    first = right.groupBy(*on, *per, *right_pos).agg(F.min(F.struct(right_id, *rest)).alias("_p"))
    first = first.select(*on, *per, *right_pos, *[F.col(f"_p.{c}").alias(c) for c in (right_id, *rest)])
    key, result = [left_id, *on, *per], ["sep", right_id, *others]
    each = Window.partitionBy(*key)
    j = radius_join(left.select(left_id, *on, *left_pos), first, radius, left_pos, right_pos, on).withColumn("_q", F.floor(F.col("sep") / ROUNDING))
    j = j.withColumn("_r", F.dense_rank().over(each.orderBy("_q"))).filter("_r <= 2")  # what is as near but for rounding lies in two steps
    j = j.withColumn("_m", F.min("sep").over(each)).filter(F.col("sep") <= F.col("_m") + ROUNDING).withColumn("_n", F.count(F.lit(1)).over(each))
    several = j.filter("_n > 1").withColumn("sep", _in_c(*left_pos, *right_pos))
    best = several.groupBy(*key).agg(F.min(F.struct(*result)).alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in result])
    return j.filter("_n = 1").select(*key, *result).union(best)


def near_pixels(left: DataFrame, right: DataFrame, r: float, on: tuple, left_xy=("x", "y"), right_xy=("mx", "my"), how: str = "left_semi", strict: bool = False) -> DataFrame:
    """Pairs (or left rows) with |dx| <= r and |dy| <= r (< r if strict), within equal `on`."""
    side = float(max(1.0, 2 * r))
    rc = right
    for k, c in enumerate(right_xy):
        rc = rc.withColumn(f"_p{k}", F.explode(F.sequence(F.floor((F.col(c) - r) / side), F.floor((F.col(c) + r) / side))))
    l, q = left.select("*", *[F.floor(F.col(c) / side).alias(f"_p{k}") for k, c in enumerate(left_xy)]).alias("l"), rc.alias("r")
    cond = F.lit(True)
    for k in (*on, "_p0", "_p1"):
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    for a, b in zip(left_xy, right_xy):
        gap = F.abs(F.col(f"l.{a}") - F.col(f"r.{b}"))
        cond = cond & ((gap < r) if strict else (gap <= r))
    return l.join(q, cond, how).drop("_p0", "_p1")


def cross_match(a: DataFrame, b: DataFrame, radius: float, a_id: str, b_id: str, on: tuple = ()) -> DataFrame:
    """Full outer match: every a with its nearest b or without, and every b that no a has; catalog_flag 0 both, 1 a only, 2 b only."""
    m = nearest(a, b, radius, a_id, b_id, on)
    matched = a.join(m, [a_id, *on], "left").withColumn("catalog_flag", F.when(F.col(b_id).isNull(), 1).otherwise(0))
    return matched.unionByName(b.join(m.select(b_id).distinct(), b_id, "left_anti").withColumn("catalog_flag", F.lit(2)), allowMissingColumns=True)


def overwritten_match(left: DataFrame, right: DataFrame, least: float, most: float, left_id: str, right_id: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    """All left rows, with right_id where the nearest right row is more than `least` and up to `most` arc seconds away.

    In matched rows a column that both sides have, but for exempt ones, is the right side's, if any matched row has a
    value in it there; else it stays as it is. right has its position as ra2, dec2.
    """
    shared = [x for x in right.columns if x in left.columns and x not in exempt]
    other = right.select(right_id, "ra2", "dec2", *[F.col(x).alias(f"_r_{x}") for x in shared])
    near = nearest(left.select(left_id, "ra", "dec"), other, most, left_id, right_id).filter(F.col("sep") > least).drop("ra2", "dec2")
    counts = near.agg(*[F.count(f"_r_{x}").alias(x) for x in shared]).first() if shared else {}
    j = left.join(near, left_id, "left")
    use = {x: F.when(F.col(right_id).isNotNull(), F.col(f"_r_{x}")).otherwise(F.col(x)) for x in shared if counts[x]}
    return j.withColumns(use).drop(*[f"_r_{x}" for x in shared]) if use else j.drop(*[f"_r_{x}" for x in shared])


def in_ranges(points: DataFrame, boxes: DataFrame, degrees: float = 1.0) -> DataFrame:
    """points (ra, dec) joined with the boxes (ra_lo, ra_hi, dec_lo, dec_hi; ra_hi beyond 360 goes through 0) that hold them.

    A box is entered in all cells of `degrees` by `degrees` that it touches, so points meet only what is near.
    """
    n = int(360 / degrees)
    cells = boxes.withColumn("_y", F.explode(F.sequence(F.floor(F.col("dec_lo") / degrees), F.floor(F.col("dec_hi") / degrees))))
    x = F.transform(F.sequence(F.floor(F.col("ra_lo") / degrees), F.floor(F.col("ra_hi") / degrees)), lambda v: F.pmod(v, F.lit(n)))
    cells = cells.withColumn("_x", F.explode(F.array_distinct(x)))
    p = points.withColumn("_x", F.pmod(F.floor(F.col("ra") / degrees), F.lit(n))).withColumn("_y", F.floor(F.col("dec") / degrees))
    inside = F.col("ra").between(F.col("ra_lo"), F.col("ra_hi")) | (F.col("ra") + 360.0).between(F.col("ra_lo"), F.col("ra_hi"))
    return p.join(cells, ["_x", "_y"]).filter(inside & F.col("dec").between(F.col("dec_lo"), F.col("dec_hi"))).drop("_x", "_y")


def within(left: DataFrame, right: DataFrame, tolerances: dict[tuple[str, str], float | tuple[float, float]]) -> DataFrame:
    """Pairs whose named columns (left, right) are close: |a - b| < t or, with a pair of tolerances, |a - b| <= absolute + relative * |b|.

    The first is also hashed into cells, in a measure in which its tolerance is about as wide everywhere, so that a
    right row enters two cells or three however large its value and tolerance are.
    """
    def measure(x: Column, t: float, r: float) -> Column:
        return x / t if not r else F.signum(x) * F.asinh(F.abs(x) * (r / t)) / r

    def reach(x: Column, t: float, r: float) -> Column:
        return t + r * F.abs(x)

    pair = lambda t: t if isinstance(t, tuple) else (t, 0.0)
    (a, b), first = next(iter(tolerances.items()))
    t, r = pair(first)
    if t <= 0:
        raise ValueError("cells need an absolute tolerance")
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    cell = lambda v: F.floor(measure(v, t, r) / 4)
    lc = left.withColumn("_w", cell(x))
    wide = reach(y, t, r) * (1 + 1e-9)
    rc = right.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))).withColumn("_w", F.explode(F.sequence(cell(y - wide), cell(y + wide))))
    j = lc.join(rc, "_w")
    for (x, y), tol in tolerances.items():
        gap = F.abs(F.col(x) - F.col(y))
        j = j.filter(gap <= reach(F.col(y), *tol) if isinstance(tol, tuple) else gap < tol)
    return j.drop("_w")
