"""Queries on light curves and on densities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import dedup, density, filters, lightcurve, spatial
from .groups import _PASS, CHAIN
from .registry import query

c = F.col


def r6(x):
    return F.round(x, 6)


_STACK = "sum(flux / (flux_unc * flux_unc)) / sum(1 / (flux_unc * flux_unc)) AS f, 1 / sqrt(sum(1 / (flux_unc * flux_unc))) AS s, sum(zp / (flux_unc * flux_unc)) / sum(1 / (flux_unc * flux_unc)) AS z, count(*) AS n"
_OUT = "round(f, 6) AS flux, round(s, 6) AS unc, n, (f <= 0 OR f / s < 3) AS upper_limit, round(CASE WHEN f <= 0 OR f / s < 3 THEN z - 2.5 * log10(5 * s) ELSE z - 2.5 * log10(f) END, 5) AS mag"


def _shown(df, *by):
    return df.select(*by, r6(c("stack_flux")).alias("flux"), r6(c("stack_unc")).alias("unc"), "n", "upper_limit", F.round("out_mag", 5).alias("mag"))


@query(f"SELECT source_id, band, {_OUT} FROM (SELECT source_id, band, {_STACK} FROM epochs GROUP BY ALL)")
def ivw_stack(t):
    return _shown(lightcurve.stack(t.epochs, ["source_id", "band"]), "source_id", "band")


@query("SELECT event_id, round(flux / flux_unc, 6) AS snr, (flux <= 0 OR flux / flux_unc < 3) AS upper_limit, round(CASE WHEN flux <= 0 OR flux / flux_unc < 3 THEN zp - 2.5 * log10(5 * flux_unc) ELSE zp - 2.5 * log10(flux) END, 5) AS mag FROM epochs")
def fp_epochs(t):
    e = lightcurve.detection_columns(t.epochs, "flux", "flux_unc", "zp")
    return e.select("event_id", r6(c("flux") / c("flux_unc")).alias("snr"), "upper_limit", F.round("out_mag", 5).alias("mag"))


@query(f"""WITH sp AS (SELECT *, min(jd) OVER w AS lo, max(jd) OVER w AS hi FROM epochs WINDOW w AS (PARTITION BY source_id, band)),
ks AS (SELECT *, unnest(range(0, CAST(greatest(ceil((hi - lo - 6 + 3) / 3), 0) AS BIGINT))) AS k FROM sp)
SELECT source_id, band, k, {_OUT} FROM (SELECT source_id, band, k, {_STACK} FROM ks WHERE jd >= lo + k * 3 AND jd < lo + k * 3 + 6 GROUP BY ALL)""")
def rolling_stack_days(t):
    return _shown(lightcurve.rolling_stack_days(t.epochs, ["source_id", "band"], 6.0), "source_id", "band", "k")


@query("""SELECT source_id, band, i, round(f, 6) AS flux, round(s, 6) AS unc FROM (SELECT source_id, band, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY source_id, band) AS n,
sum(flux / (flux_unc * flux_unc)) OVER w / sum(1 / (flux_unc * flux_unc)) OVER w AS f, 1 / sqrt(sum(1 / (flux_unc * flux_unc)) OVER w) AS s
FROM epochs WINDOW o AS (PARTITION BY source_id, band ORDER BY jd, event_id), w AS (PARTITION BY source_id, band ORDER BY jd, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE i >= 2 AND i < n - 2 AND (i - 2) % 2 = 0""")
def rolling_stack_images(t):
    s = lightcurve.rolling_stack_rows(t.epochs, ["source_id", "band"], 5, 2)
    return s.select("source_id", "band", c("i").cast("long"), r6(c("stack_flux")).alias("flux"), r6(c("stack_unc")).alias("unc"))


@query("SELECT event_id, CAST(sum(new) OVER (PARTITION BY source_id ORDER BY jd, event_id) AS BIGINT) AS epoch_no FROM (SELECT *, CASE WHEN jd - lag(jd) OVER (PARTITION BY source_id ORDER BY jd, event_id) > 2 THEN 1 ELSE 0 END AS new FROM epochs)")
def epoch_split(t):
    return lightcurve.epoch_split(t.epochs, ["source_id"], 2.0).select("event_id", "epoch_no")


@query("""WITH RECURSIVE o AS (SELECT source_id, jd, event_id, flux, row_number() OVER (PARTITION BY source_id ORDER BY jd, event_id) AS i FROM epochs),
w AS (SELECT source_id, i, jd, flux, jd AS t0 FROM o WHERE i = 1 UNION ALL SELECT o.source_id, o.i, o.jd, o.flux, CASE WHEN o.jd < w.t0 + 3 THEN w.t0 ELSE o.jd END FROM w JOIN o ON o.source_id = w.source_id AND o.i = w.i + 1)
SELECT source_id, round(t0, 6) AS t0, round(avg(jd), 6) AS mean_jd, round(avg(flux), 6) AS mean_flux, count(*) AS n FROM w GROUP BY source_id, t0""")
def window3d_collapse(t):
    return lightcurve.anchored_windows(t.epochs, ["source_id"], 3.0).select("source_id", r6(c("t0")).alias("t0"), r6(c("mean_jd")).alias("mean_jd"), r6(c("mean_flux")).alias("mean_flux"), "n")


@query("""WITH RECURSIVE o AS (SELECT source_id, band, jd, event_id, flux, flux_unc, row_number() OVER (PARTITION BY source_id, band ORDER BY jd, event_id) AS i FROM epochs),
w AS (SELECT source_id, band, i, jd, flux, flux_unc, jd AS t0, 0 AS tie FROM o WHERE i = 1 UNION ALL SELECT o.source_id, o.band, o.i, o.jd, o.flux, o.flux_unc, CASE WHEN o.jd <= w.t0 + 1 THEN w.t0 ELSE o.jd END, CASE WHEN o.jd = w.t0 THEN o.i ELSE 0 END FROM w JOIN o ON o.source_id = w.source_id AND o.band = w.band AND o.i = w.i + 1)
SELECT source_id, band, round(avg(jd), 6) AS jd, round(avg(flux), 6) AS flux, round(sqrt(sum(flux_unc * flux_unc)) / count(*), 6) AS flux_unc, count(*) AS n FROM w GROUP BY source_id, band, t0, tie""")
def same_night_collapse(t):
    """Greedy: from the first row of a band on, rows within a day, but at another time, are merged with it."""
    return lightcurve.same_night(t.epochs, ["source_id", "band"]).select("source_id", "band", *[r6(c(x)).alias(x) for x in ("jd", "flux", "flux_unc")], "n")


@query("SELECT event_id, round(jd - first_value(jd) OVER (PARTITION BY source_id ORDER BY flux DESC, event_id), 6) AS dt FROM epochs")
def peak_align(t):
    w = Window.partitionBy("source_id").orderBy(F.desc("flux"), "event_id")
    return t.epochs.select("event_id", r6(c("jd") - F.first("jd").over(w)).alias("dt"))


@query("SELECT source_id, event_id, row_number() OVER (PARTITION BY source_id ORDER BY jd, event_id) AS i FROM epochs")
def sort_lc(t):
    return t.epochs.select("source_id", "event_id", F.row_number().over(Window.partitionBy("source_id").orderBy("jd", "event_id")).cast("long").alias("i"))


def _arrays(t):
    e = F.array_sort(F.collect_list(F.struct("jd", "event_id", "flux", "flux_unc", "catflags")))
    return t.epochs.groupBy("source_id", "band").agg(e.alias("e")).select("source_id", "band", *[c("e").getField(f).alias(f) for f in ("jd", "event_id", "flux", "flux_unc", "catflags")])


@query("SELECT source_id, event_id, CASE WHEN band = 'g' THEN flux END AS g_flux, CASE WHEN band = 'r' THEN flux END AS r_flux, CASE WHEN band = 'i' THEN flux END AS i_flux FROM epochs WHERE (catflags & 6141) = 0")
def explode_lc(t):
    rows = _arrays(t).select("source_id", "band", F.explode(F.arrays_zip("jd", "event_id", "flux", "catflags")).alias("x"))
    rows = rows.filter(c("x.catflags").bitwiseAND(6141) == 0)
    return rows.select("source_id", "x.event_id", *[F.when(c("band") == b, c("x.flux")).alias(f"{b}_flux") for b in "gri"])


@query("SELECT source_id, band, count(*) FILTER (WHERE (catflags & 6141) = 0) AS n FROM epochs GROUP BY ALL")
def catflag_mask(t):
    good = F.filter(F.arrays_zip("catflags", "flux"), lambda x: (x["catflags"].bitwiseAND(6141) == 0) & x["flux"].isNotNull())
    return _arrays(t).select("source_id", "band", F.size(good).cast("long").alias("n"))


@query("SELECT source_id, concat_ws(',', CASE WHEN bool_or(band = 'g') THEN 'g' END, CASE WHEN bool_or(band = 'r') THEN 'r' END, CASE WHEN bool_or(band = 'i') THEN 'i' END) AS bands FROM epochs GROUP BY 1")
def bands_present(t):
    order = F.array(F.lit("g"), F.lit("r"), F.lit("i"))
    return t.epochs.groupBy("source_id").agg(F.concat_ws(",", F.array_intersect(order, F.collect_set("band"))).alias("bands"))


#: What surveys call their filters, and the band of each.
FILTER_IDS = {"ptf": {"1": "G", "2": "R"}, "panstarr": {"1": "g", "2": "r", "3": "i", "4": "z", "5": "y"}, "ztf": {"zg": "g", "zr": "r", "zi": "i"}}
_IDS = """s AS (SELECT source_id, jd, flux, CASE source_id % 3 WHEN 0 THEN 'ztf' WHEN 1 THEN 'panstarr' ELSE 'ptf' END AS survey, band, event_id FROM epochs),
n AS (SELECT source_id, jd, flux, survey, CASE survey WHEN 'ztf' THEN 'z' || band WHEN 'panstarr' THEN CAST(event_id % 5 + 1 AS VARCHAR) ELSE CAST(event_id % 2 + 1 AS VARCHAR) END AS fid FROM s),
m(survey, fid, name) AS (VALUES """ + ", ".join(f"('{x}', '{i}', '{n}')" for x, ids in FILTER_IDS.items() for i, n in ids.items()) + ")"
_NAMES = ("G", "R", "g", "r", "i", "z", "y")
_SHOWN = {"G": "ptf_G", "R": "ptf_R"} | {b: f"{b}_flux" for b in "grizy"}


@query(f"WITH {_IDS} SELECT source_id, survey, CAST(floor(jd) AS BIGINT) AS night, {', '.join(f'round(max(flux) FILTER (WHERE name = {chr(39)}{n}{chr(39)}), 6) AS {_SHOWN[n]}' for n in _NAMES)} FROM n JOIN m USING (survey, fid) GROUP BY ALL")
def pivot_filter_id(t):
    """Filters by their numbers or codes in three surveys, as columns of bands."""
    survey = F.element_at(F.array(*map(F.lit, ("ztf", "panstarr", "ptf"))), (c("source_id") % 3 + 1).cast("int"))
    e = t.epochs.withColumn("survey", survey)
    fid = F.when(c("survey") == "ztf", F.concat(F.lit("z"), "band")).when(c("survey") == "panstarr", (c("event_id") % 5 + 1).cast("string")).otherwise((c("event_id") % 2 + 1).cast("string"))
    names = F.create_map(*[F.lit(v) for x, ids in FILTER_IDS.items() for i, n in ids.items() for v in (f"{x} {i}", n)])
    p = e.withColumn("name", names[F.concat_ws(" ", "survey", fid)]).groupBy("source_id", "survey", F.floor("jd").alias("night"))
    return p.agg(*[r6(F.max(F.when(c("name") == n, c("flux")))).alias(_SHOWN[n]) for n in _NAMES])


@query("SELECT event_id, round(flux / flux_unc, 6) AS w1snr FROM epochs")
def wise_snr(t):
    return t.epochs.select("event_id", r6(F.try_divide("flux", "flux_unc")).alias("w1snr"))


def _dmag(t):
    m = t.matched.filter("mag is not null")
    err = F.greatest(F.sqrt(c("psf_err") * c("psf_err") + c("magerr") * c("magerr")), F.lit(0.01))
    return m.select("src_id", "k", "band", c("mag").alias("b_mag"), ((c("psf_mag") + c("mag")) / 2).alias("mag"), (c("psf_mag") - c("mag")).alias("dmag"), err.alias("err"))


_KDE = """WITH d AS (SELECT src_id, k, band, mag AS b_mag, (psf_mag + mag) / 2 AS mag, psf_mag - mag AS dmag, greatest(sqrt(psf_err * psf_err + magerr * magerr), 0.01) AS err FROM matched WHERE mag IS NOT NULL),
cs AS (SELECT 14 + 0.25e0 * unnest(range(0, 40)) AS c), gs AS (SELECT -5 + unnest(range(0, 1000)) * (10e0 / 999) AS g),
e AS (SELECT band, c, g AS d, avg(exp(-0.5 * pow((g - dmag) / err, 2)) / (err * sqrt(2 * pi()))) AS density, count(*) AS n FROM d JOIN cs ON abs(mag - c) < 0.5, gs GROUP BY band, c, g HAVING count(*) > 1)"""
_AT = "min(CASE WHEN cdf >= {p} AND coalesce(cdf0, -1) < {p} THEN coalesce(d0 + (d - d0) * ({p} - cdf0) / (cdf - cdf0), d) END)"
_BOUNDS = _KDE + f""", cum AS (SELECT band, c, d, sum(density) OVER (PARTITION BY band, c ORDER BY d ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY band, c) AS cdf FROM e),
lagged AS (SELECT *, lag(cdf) OVER (PARTITION BY band, c ORDER BY d) AS cdf0, lag(d) OVER (PARTITION BY band, c ORDER BY d) AS d0 FROM cum),
bounds AS (SELECT band, c, {_AT.format(p=repr(density.LOW))} AS low, {_AT.format(p=repr(density.HIGH))} AS high FROM lagged GROUP BY band, c)"""
_BIG = _BOUNDS + """, placed AS (SELECT *, greatest(0e0, least(39e0, (mag - 14) / 0.25e0)) AS place FROM d), cell AS (SELECT *, CAST(least(floor(place), 38) AS BIGINT) AS ci FROM placed),
lim AS (SELECT cell.*, place - ci AS t, x.low AS l1, x.high AS h1, y.low AS l2, y.high AS h2 FROM cell LEFT JOIN bounds x ON x.band = cell.band AND round((x.c - 14) / 0.25e0) = ci LEFT JOIN bounds y ON y.band = cell.band AND round((y.c - 14) / 0.25e0) = ci + 1),
big AS (SELECT *, coalesce(dmag < CASE WHEN t = 0 THEN l1 WHEN t = 1 THEN l2 ELSE l1 + t * (l2 - l1) END OR dmag > CASE WHEN t = 0 THEN h1 WHEN t = 1 THEN h2 ELSE h1 + t * (h2 - h1) END, false) AND b_mag > 14 AS big FROM lim)"""


@query(_KDE + " SELECT band, c, round(d, 6) AS d, round(density, 5) AS density FROM e")
def kde_envelope(t):
    return density.kde_envelope(_dmag(t)).select("band", "c", r6(c("d")).alias("d"), F.round("density", 5).alias("density"))


@query(_KDE.replace("SELECT src_id, k, band,", "SELECT src_id, k, fieldid % 2 || band AS band,") + " SELECT CAST(left(band, 1) AS BIGINT) AS half, right(band, 1) AS band, c, round(d, 6) AS d, round(density, 5) AS density FROM e")
def envelope_cache(t):
    """Envelopes of one band are stored first, then what is missing of all bands; each by half of the fields."""
    path = f"{dedup.shared_folder(t.spark)}/envelopes-{uuid.uuid4().hex}"
    d = _dmag(t).join(t.matched.select("src_id", (c("fieldid") % 2).alias("half")), "src_id")
    density.cached_envelopes(d.filter("band = 'g'"), path, "half")
    return density.cached_envelopes(d, path, "half").select("half", "band", "c", r6(c("d")).alias("d"), F.round("density", 5).alias("density"))


@query(_BOUNDS + " SELECT band, c, round(low, 6) AS low, round(high, 6) AS high FROM bounds")
def envelope_percentile(t):
    return density.envelope_percentiles(density.kde_envelope(_dmag(t))).select("band", "c", r6(c("low")).alias("low"), r6(c("high")).alias("high"))


def _big(t, least=density.LOW, most=density.HIGH):
    d = _dmag(t)
    return density.big_differences(d, density.envelope_percentiles(density.kde_envelope(d), least, most)).withColumn("big", c("big") & (c("b_mag") > 14))


@query(_BIG + " SELECT src_id, band, round(dmag, 6) AS dmag FROM big WHERE big")
def only_big_dmag(t):
    return _big(t).filter("big").select("src_id", "band", r6(c("dmag")).alias("dmag"))


@query(_BIG.replace(repr(density.LOW), repr(density.ONE[0])).replace(repr(density.HIGH), repr(density.ONE[1])) + ", flags AS (SELECT k, count(*) AS n FROM matched WHERE catalog_flag = 0 GROUP BY k) SELECT k, count(*) AS n_big FROM big JOIN flags USING (k) WHERE big AND n > 1 GROUP BY k HAVING count(*) >= 2")
def n_big_dmag_bands(t):
    """Objects whose difference is big, here by one sigma, in two bands or more, and that are of the branch in more than one."""
    of_branch = t.matched.filter("catalog_flag = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    return _big(t, *density.ONE).filter("big").groupBy("k").agg(F.count(F.lit(1)).alias("n_big")).filter("n_big >= 2").join(of_branch, "k", "left_semi")


@query("WITH " + _PASS + " SELECT f.src_id FROM f JOIN matched USING (src_id) WHERE matched.catalog_flag = 0 AND mag IS NOT NULL AND p1 AND p2 AND p3 AND p4 AND p5")
def kde_filtered_input(t):
    """What the density estimates are made from: rows of both surveys that pass five filters."""
    both = t.matched.filter("catalog_flag = 0 and mag is not null")
    return filters.flagged(both, CHAIN[:5]).filter("reject_reason is null").select("src_id")


@query(_KDE.split(",\ncs AS")[0] + """, n AS (SELECT band, c, dmag, exp(-0.5 * pow((mag - c) / 0.5, 2)) AS w FROM d, (SELECT unnest([16e0, 18e0, 20e0, 22e0]) AS c) cc WHERE abs((mag - c) / 0.5) <= 8), s AS (SELECT band, c, sum(w) AS sw, sum(w * w) AS sw2, sum(w * dmag) / sum(w) AS mu FROM n GROUP BY ALL),
v AS (SELECT band, c, sw, sum(w * (dmag - mu) * (dmag - mu)) / sw / (1 - sw2 / (sw * sw)) * pow(sw * sw / sw2 * 0.75, -0.4) AS var FROM n JOIN s USING (band, c) WHERE sw * sw / sw2 > 1 GROUP BY band, c, sw, sw2), g AS (SELECT -5 + 0.5e0 * unnest(range(0, 21)) AS d)
SELECT band, c, g.d, round(sum(w / sw * exp(-0.5 * (g.d - dmag) * (g.d - dmag) / var) / sqrt(2 * pi() * var)), 6) AS density FROM n JOIN v USING (band, c), g WHERE var > 0 GROUP BY ALL""")
def weighted_kde(t):
    return density.weighted_kde(_dmag(t), [16.0, 18.0, 20.0, 22.0]).select("band", "c", "d", F.round("density", 6).alias("density"))
