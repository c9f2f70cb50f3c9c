"""Queries on two-dimensional densities, distances, cones, calibration stars and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import photometry as P
from ..operators import density, filters, spatial
from .curves import _KDE, _dmag
from .groups import _RANGE, CHAIN, _funnel_sql, ranges
from .joins import _SEP
from .registry import query

c = F.col
_D = _KDE.split(",\ncs AS")[0]
_GRID = _D + """, s AS (SELECT band, count(*) AS n, var_samp(mag) * pow(count(*), -1e0 / 3) AS xx, var_samp(dmag) * pow(count(*), -1e0 / 3) AS yy, covar_samp(mag, dmag) * pow(count(*), -1e0 / 3) AS xy FROM d GROUP BY band),
gi AS (SELECT unnest(range(0, 100)) AS i), gj AS (SELECT unnest(range(0, 100)) AS j),
g AS (SELECT band, i, j, sum(exp(-0.5 * (yy * pow(11 + i * (14e0 / 99) - mag, 2) - 2 * xy * (11 + i * (14e0 / 99) - mag) * (-5 + j * (10e0 / 99) - dmag) + xx * pow(-5 + j * (10e0 / 99) - dmag, 2)) / (xx * yy - xy * xy)) / (n * 2 * pi() * sqrt(xx * yy - xy * xy))) AS density FROM d JOIN s USING (band), gi, gj GROUP BY ALL)"""


@query(_GRID + " SELECT band, i, j, round(density, 6) AS density FROM g WHERE density > 1e-5")
def kde2d_grid(t):
    return density.kde2d_grid(_dmag(t), ["band"]).filter("density > 1e-5").select("band", "i", "j", F.round("density", 6).alias("density"))


@query(_GRID + ", r AS (SELECT band, density, sum(density) OVER (PARTITION BY band ORDER BY density DESC ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY band) AS m FROM g) SELECT band, round(max(density), 6) AS level FROM r WHERE m >= 0.9973 GROUP BY band")
def hdr_level(t):
    return density.hdr_level(density.kde2d_grid(_dmag(t), ["band"]), ["band"]).select("band", F.round("level", 6).alias("level"))


_SCORE = _GRID + """, r AS (SELECT band, density, sum(density) OVER (PARTITION BY band ORDER BY density DESC ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY band) AS m FROM g), lev AS (SELECT band, max(density) AS level FROM r WHERE m >= 0.9973 GROUP BY band),
q AS (SELECT src_id, band, mag, dmag, (mag - 11) * 99 / 14 AS u, (dmag + 5) * 99 / 10 AS v FROM d), q2 AS (SELECT *, floor(u) AS i0, floor(v) AS j0 FROM q),
sc AS (SELECT src_id, q2.band, CASE WHEN mag BETWEEN 11 AND 25 AND dmag BETWEEN -5 AND 5 THEN (1 - (u - i0)) * ((1 - (v - j0)) * coalesce(a.density, 0) + (v - j0) * coalesce(b.density, 0)) + (u - i0) * ((1 - (v - j0)) * coalesce(e.density, 0) + (v - j0) * coalesce(f.density, 0)) END AS score
FROM q2 LEFT JOIN g a ON a.band = q2.band AND a.i = i0 AND a.j = j0 LEFT JOIN g b ON b.band = q2.band AND b.i = i0 AND b.j = j0 + 1 LEFT JOIN g e ON e.band = q2.band AND e.i = i0 + 1 AND e.j = j0 LEFT JOIN g f ON f.band = q2.band AND f.i = i0 + 1 AND f.j = j0 + 1)"""


@query(_SCORE + " SELECT src_id, band, round(score, 6) AS score, coalesce(score < level, false) AS kept FROM sc LEFT JOIN lev USING (band)")
def kde_filter(t):
    d = _dmag(t)
    grid = density.kde2d_grid(d, ["band"])
    return density.kde_filter(d, grid, density.hdr_level(grid, ["band"]), ["band"]).select("src_id", "band", F.round("score", 6).alias("score"), "kept")


_ZQ = "0.01e0 + (source_id % 50) / 1000e0"
_MPC = f"(1 + {_ZQ}) * 299792.458e0 / 70 * ({_ZQ}) / 192 * list_sum(list_transform(range(0, 65), lambda i: CASE WHEN i = 0 OR i = 64 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / sqrt(0.3e0 * pow(1 + ({_ZQ}) * i / 64, 3) + 0.7e0)))"


@query(f"WITH m AS (SELECT event_id, source_id, jd, {_ZQ} AS z, -2.5 * log10(flux) + zp - 5 * (log10(1e6 * {_MPC}) - 1) + 2.5 * log10(1 + {_ZQ}) AS a FROM epochs WHERE flux > 0) SELECT event_id, round(a, 6) AS abs_mag, round((jd - first_value(jd) OVER (PARTITION BY source_id ORDER BY a, event_id)) / (1 + z), 6) AS rest_time FROM m")
def absolute_mag(t):
    e = t.epochs.filter("flux > 0").withColumn("z", 0.01 + (c("source_id") % 50) / 1000.0)
    e = e.withColumn("abs_mag", P.absolute_mag(P.flux_to_mag(c("flux"), c("zp")), c("z")))
    peak = F.first("jd").over(Window.partitionBy("source_id").orderBy("abs_mag", "event_id"))
    return e.select("event_id", F.round("abs_mag", 6).alias("abs_mag"), F.round((c("jd") - peak) / (1 + c("z")), 6).alias("rest_time"))


@query("SELECT obj_id, round(sep, 4) AS sep FROM (SELECT b.obj_id, " + _SEP + " AS sep FROM (SELECT 13.7e0 AS ra, -23e0 AS dec) a, cat_b b) WHERE sep <= 1800 ORDER BY sep, obj_id")
def cone_sorted(t):
    near = t.cat_b.filter(F.abs(c("dec") + 23.0) <= 0.51).withColumn("sep", spatial.separation(F.lit(13.7), F.lit(-23.0), c("ra"), c("dec")))
    return near.filter("sep <= 1800").select("obj_id", F.round("sep", 4).alias("sep")).orderBy("sep", "obj_id")


@query(_funnel_sql("band") + " ORDER BY band, stage")
def funnel_order(t):
    return filters.funnel(t.matched, CHAIN, ["band"]).orderBy("band", "stage")


@query("SELECT src_id, k, ra, dec, band, psf_mag FROM cat_a")
def column_order(t):
    first = ["src_id", "k", "ra", "dec"]
    return t.cat_a.select(*first, *[x for x in t.cat_a.columns if x in ("band", "psf_mag")])


_INDEX = "ix AS (SELECT k AS series, fieldid, ra, dec FROM pos WHERE k IN (SELECT source_id FROM epochs)), tg AS (SELECT src_id, fieldid, ra, dec FROM cat_a WHERE k IN (SELECT source_id FROM epochs))"


@query(f"WITH {_INDEX} SELECT a.src_id, b.series, round({_SEP}, 4) AS sep FROM tg a JOIN ix b ON a.fieldid = b.fieldid AND abs(a.dec - b.dec) < 0.001 WHERE {_SEP} <= 0.5 QUALIFY row_number() OVER (PARTITION BY a.src_id ORDER BY {_SEP}, b.series) = 1")
def fp_lookup(t):
    """The series nearest to each target, within half an arc second; a target without one is an error."""
    ids = t.epochs.select(c("source_id").alias("k")).distinct()
    index = t.pos.join(ids, "k").select(c("k").alias("series"), c("ra").alias("ra2"), c("dec").alias("dec2"))
    targets = t.cat_a.join(ids, "k", "left_semi").select("src_id", "ra", "dec")
    near = spatial.nearest(targets, index, 0.5, "src_id", "series").select("src_id", "series", F.round("sep", 4).alias("sep"))
    none = F.raise_error(F.concat(F.lit("no series near source "), c("src_id").cast("string"))).cast("long")
    return targets.select("src_id").join(near, "src_id", "left").select("src_id", F.when(c("series").isNotNull(), c("series")).otherwise(none).alias("series"), "sep")


_QUAD = ("fieldid", "ccdid", "qid")
#: The derived table has no source with a difference under 0.05, the usual limit of calibration_stars; here it is 0.1.


@query("""WITH s AS (SELECT * FROM cat_a WHERE 2.5 / ln(10) / psf_err >= 10 AND psf_mag - kron_mag < 0.1 AND psf_mag < 17)
SELECT src_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM cat_a o WHERE o.fieldid = a.fieldid AND o.ccdid = a.ccdid AND o.qid = a.qid AND o.band = a.band AND o.src_id <> a.src_id AND pow(o.x - a.x, 2) + pow(o.y - a.y, 2) <= 100)
AND (SELECT count(*) FROM masked m WHERE m.fieldid = a.fieldid AND m.ccdid = a.ccdid AND m.qid = a.qid AND abs(m.mx - a.x) <= 25 AND abs(m.my - a.y) <= 25) < 0.05 * 2601""")
def calibration_stars(t):
    s = t.cat_a.filter((P.snr(c("psf_mag"), c("psf_err")) >= 10) & (c("psf_mag") - c("kron_mag") < 0.1) & (c("psf_mag") < 17)).select("src_id", *_QUAD, "band", "x", "y")
    other = t.cat_a.select(*_QUAD, "band", c("src_id").alias("other"), c("x").alias("mx"), c("y").alias("my"))
    crowded = spatial.near_pixels(s, other, 10, (*_QUAD, "band"), how="inner").filter("src_id <> other and pow(mx - x, 2) + pow(my - y, 2) <= 100").select("src_id")
    bad = spatial.near_pixels(s, t.masked, 25, _QUAD, how="inner").groupBy("src_id").count().filter(c("count") >= 0.05 * 51 * 51).select("src_id")
    return s.select("src_id").join(crowded.union(bad), "src_id", "left_anti")
