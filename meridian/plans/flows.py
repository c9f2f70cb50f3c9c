"""Queries that chain many steps: the three branches of the search, and what goes through files and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import photometry as P
from ..operators import dedup, density, filters, spatial
from ..sources import files
from ..streaming import jobs
from .curves import _BIG, r6
from .groups import CHAIN, _funnel_sql
from .joins import _SEP
from .more import _D, _SCORE
from .registry import query
from .scalars import MOVED, SNR_A, SNR_B, SNR_BOTH

c = F.col

#: Filters of each branch in turn, before differences are looked at.
BRANCHES = {
    0: ["extraction", "shape", "not_saturated", "psf_fit", "dec_above"],
    1: ["extraction", "not_extended_artifact", "snr_any", "shape", "psf_fit", "dec_above"],
    2: ["fainter_than_zero", "not_saturated", "quality", "snr_any", "dec_above"],
}
NEARBY, RADIUS = 5, 200.0


def _sources(t) -> DataFrame:
    """Rows of both surveys and of A alone, and for each band the objects of B that A has in no band."""
    alone = t.cat_b.join(t.cat_a.select("k"), c("obj_id") == c("k"), "left_anti").withColumn("band", F.explode(F.array(*map(F.lit, "gri"))))
    rank = F.when(c("band") == "g", 1).when(c("band") == "r", 2).otherwise(3)
    alone = alone.withColumns({"band_rank": rank.cast("long"), "src_id": -(c("obj_id") * 10 + rank), "k": c("obj_id"), "catalog_flag": F.lit(2), "mag_limit": F.lit(22.0)})
    return t.matched.unionByName(alone.select(*[x for x in t.matched.columns if x in alone.columns]), allowMissingColumns=True)


def outside_envelopes(known: DataFrame, rows: DataFrame, least: float, most: float) -> DataFrame:
    """The rows whose difference lies beyond the percentiles of known ones."""
    bounds = density.envelope_percentiles(density.kde_envelope(known), least, most)
    return density.big_differences(rows, bounds).filter(c("big") & (c("b_mag") > 14))


def outside_densities(known: DataFrame, rows: DataFrame, mass: float) -> DataFrame:
    """The rows where the density of known ones is under the level that encloses that share of it."""
    grid = dedup.kept(density.kde2d_grid(known, ["band"]))
    return density.kde_filter(rows, grid, density.hdr_level(grid, ["band"], mass), ["band"]).filter(c("kept") & c("b_mag").isNotNull())


def branches(t, outside) -> DataFrame:
    """branch, k, bands, n_big of the objects that stay in each branch.

    Rows of both surveys that one of them alone sees with confidence go on in that one's branch. outside(known, rows)
    picks rows by what is usual among known ones, those that branch 0 keeps. A limit stands for the survey that hasn't
    seen a row.
    """
    names = dict.fromkeys([*(n for chain in BRANCHES.values() for n in chain), "snr_both", "snr_a_only", "snr_b_only"])
    f = filters.flagged(_sources(t), list(names))
    passed = {b: reduce(lambda x, y: x & y, [c(f"pass_{n}") for n in chain]) for b, chain in BRANCHES.items()}
    both = (c("catalog_flag") == 0) & passed[0]
    labels = [F.when(both & c("pass_snr_both"), 0)]
    labels += [F.when(((c("catalog_flag") == b) | (both & c(f"pass_snr_{x}_only"))) & passed[b], b) for b, x in ((1, "a"), (2, "b"))]
    rows = f.withColumn("branch", F.explode(F.array_compact(F.array(*labels))))
    a, b = P.effective_mags(c("branch"))
    err = F.greatest(F.sqrt(c("psf_err") * c("psf_err") + c("magerr") * c("magerr")), F.lit(0.01))
    d = dedup.kept(rows.select("branch", "src_id", "k", "band", "band_rank", "ra", "dec", b.alias("b_mag"), ((a + b) / 2).alias("mag"), (a - b).alias("dmag"), err.alias("err")))
    big = outside(d.filter("branch = 0 and mag is not null"), d)
    place = F.min_by(F.struct("ra", "dec"), "band_rank")
    found = big.groupBy("branch", "k").agg(F.count(F.lit(1)).alias("n_big"), F.concat_ws(",", F.array_sort(F.collect_set("band"))).alias("bands"), place.alias("p"))
    found = dedup.kept(found.filter((c("n_big") >= 2) | (c("branch") == 2)).select("branch", "k", "n_big", "bands", "p.ra", "p.dec"))
    crowd = dedup.few_neighbours(found.filter("branch = 1"), "k", RADIUS, NEARBY).filter("not alone").select("k", F.lit(1).alias("branch"))
    ra, dec = P.propagated(c("ra"), c("dec"), c("pmra"), c("pmdec"), 2021.0 - c("ref_epoch"))
    stars = t.stars.select("star_id", ra.alias("ra2"), dec.alias("dec2"), "parallax_over_error", "pmra", "pmdec", "pm_err", "params_solved")
    star = spatial.nearest(found.filter("branch < 2"), stars, 5.0, "k", "star_id", on=()).drop("ra2", "dec2")
    pm = F.sqrt(c("pmra") * c("pmra") + c("pmdec") * c("pmdec")) / (c("pm_err") + c("pm_err"))
    moving = ~F.coalesce(F.when(c("pmra").isNull(), c("params_solved") == 31).otherwise(pm < 5), F.lit(False))
    near = star.filter(moving | F.coalesce(c("parallax_over_error") >= 5, F.lit(False))).select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"))
    return found.join(crowd.union(near), ["branch", "k"], "left_anti").select("branch", "k", "bands", "n_big")


_EXT, _SHAPE, _FIT, _DEC = "(CAST(coalesce(sep_flag, 0) AS BIGINT) & 252) = 0", "(a IS NULL OR coalesce(a / b < 2 AND (a / b < 1.35 OR npix < 200), false))", "(psf_flag IS NULL OR psf_flag = 0)", "dec > -29.5"
_SAT = "(coalesce(info_flag, 0) & 4224) = 0 AND (coalesce(info_flag2, 0) & 4096) = 0 AND (psf_mag IS NULL OR psf_mag > 13.5)"
_ANY = "coalesce(greatest(2.5 / ln(10) / CASE WHEN psf_mag IS NOT NULL THEN psf_err END, CASE WHEN mag IS NOT NULL THEN 2.5 / ln(10) / magerr END, 2.5 / ln(10) / CASE WHEN kron_mag IS NOT NULL THEN kron_err END, CASE WHEN b_kron_mag IS NOT NULL THEN 2.5 / ln(10) / b_kron_err END) > 5, false)"
_ART = "NOT coalesce((CAST(sep_flag AS BIGINT) & 1) <> 0 AND psf_mag - kron_mag > 1.5, false)"
_QUAL = "NOT ((coalesce(quality_flag, 0) & 131) <> 0 OR (coalesce(obj_info_flag, 0) & 1098907648) <> 0)"
_COLUMNS = "src_id, k, band, band_rank, ra, dec, psf_mag, psf_err, kron_mag, kron_err, sep_flag, psf_flag, a, b, npix, mag_limit, mag, magerr, b_kron_mag, b_kron_err, info_flag, info_flag2, quality_flag, obj_info_flag, catalog_flag"
_ALONE = "-(obj_id * 10 + band_rank), obj_id, band, band_rank, ra, dec, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 22e0, mag, magerr, b_kron_mag, b_kron_err, info_flag, info_flag2, quality_flag, obj_info_flag, 2"
_BRANCH_SQL = f"""WITH {MOVED}, m AS (SELECT {_COLUMNS} FROM matched UNION ALL SELECT {_ALONE} FROM cat_b, (VALUES ('g', 1), ('r', 2), ('i', 3)) bb(band, band_rank) WHERE obj_id NOT IN (SELECT k FROM cat_a)),
q0 AS (SELECT *, {SNR_BOTH} AS sboth, {SNR_A} AS sa, {SNR_B} AS sb FROM m WHERE catalog_flag = 0 AND {_EXT} AND {_SHAPE} AND {_SAT} AND {_FIT} AND {_DEC}),
one AS (SELECT {_COLUMNS} FROM m WHERE catalog_flag = 1 UNION ALL SELECT {_COLUMNS} FROM q0 WHERE sa), two AS (SELECT {_COLUMNS} FROM m WHERE catalog_flag = 2 UNION ALL SELECT {_COLUMNS} FROM q0 WHERE sb),
br AS (SELECT 0 AS branch, {_COLUMNS} FROM q0 WHERE sboth UNION ALL SELECT 1, {_COLUMNS} FROM one WHERE {_EXT} AND {_ART} AND {_ANY} AND {_SHAPE} AND {_FIT} AND {_DEC} UNION ALL SELECT 2, {_COLUMNS} FROM two WHERE mag > 0 AND mag < 22.5 AND {_SAT} AND {_QUAL} AND {_ANY} AND {_DEC}),
eff AS (SELECT *, CASE WHEN branch = 2 THEN mag_limit ELSE psf_mag END AS ea, CASE WHEN branch = 1 THEN CASE band WHEN 'g' THEN 23.3e0 WHEN 'r' THEN 23.2e0 ELSE 23.1e0 END ELSE mag END AS eb FROM br),
alld AS (SELECT branch, src_id, k, band, band_rank, ra, dec, eb AS b_mag, (ea + eb) / 2 AS mag, ea - eb AS dmag, greatest(sqrt(psf_err * psf_err + magerr * magerr), 0.01) AS err FROM eff),
d AS (SELECT * FROM alld WHERE branch = 0 AND mag IS NOT NULL),
""" + ("cs AS" + _BIG.split(",\ncs AS", 1)[1]).replace(repr(density.LOW), repr(density.ONE[0])).replace(repr(density.HIGH), repr(density.ONE[1])).replace("AS place FROM d)", "AS place FROM alld)") + f""",
fnd AS (SELECT branch, k, count(*) AS n_big, string_agg(DISTINCT band, ',' ORDER BY band) AS bands, min_by(ra, band_rank) AS ra, min_by(dec, band_rank) AS dec FROM big WHERE big GROUP BY ALL HAVING count(*) >= 2 OR branch = 2),
one1 AS (SELECT * FROM fnd WHERE branch = 1), crowd AS (SELECT a.k FROM one1 a JOIN one1 b ON abs(a.dec - b.dec) < 0.06 WHERE {_SEP} <= 200 GROUP BY a.k HAVING count(*) > 5),
star AS (SELECT a.branch, a.k, b.parallax_over_error, b.pmra, b.pmdec, b.pm_err, b.params_solved FROM fnd a JOIN moved b ON abs(a.dec - b.dec) < 0.002 WHERE a.branch < 2 AND {_SEP} <= 5 QUALIFY row_number() OVER (PARTITION BY a.branch, a.k ORDER BY {_SEP}, b.star_id) = 1),
gone AS (SELECT branch, k FROM star WHERE NOT coalesce(CASE WHEN pmra IS NULL THEN params_solved = 31 ELSE sqrt(pmra * pmra + pmdec * pmdec) / (pm_err + pm_err) < 5 END, false) OR coalesce(parallax_over_error >= 5, false) UNION ALL SELECT 1, k FROM crowd)
SELECT branch, k, bands, n_big FROM fnd WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.branch = fnd.branch AND g.k = fnd.k)"""


@query(_BRANCH_SQL)
def filter_branches(t):
    """The whole search, here with differences of one sigma, as the derived tables have few larger ones."""
    return branches(t, lambda known, rows: outside_envelopes(known, rows, *density.ONE))


_BY_DENSITY = _BRANCH_SQL[: _BRANCH_SQL.index("cs AS")].rstrip().rstrip(",") + _SCORE[len(_D) :].replace("q AS (SELECT src_id, band,", "q AS (SELECT branch, k, band_rank, ra, dec, b_mag, src_id, band,").replace("FROM d), q2", "FROM alld), q2")
_BY_DENSITY = _BY_DENSITY.replace("sc AS (SELECT src_id, q2.band,", "sc AS (SELECT q2.branch, q2.k, q2.band_rank, q2.ra, q2.dec, q2.b_mag, src_id, q2.band,").replace("0.9973", "0.9")
_BY_DENSITY += ",\nbig AS (SELECT sc.*, coalesce(score < level, false) AND b_mag IS NOT NULL AS big FROM sc LEFT JOIN lev USING (band))" + _BRANCH_SQL[_BRANCH_SQL.index(",\nfnd AS") :]


@query(_BY_DENSITY)
def filter_branches_density(t):
    """The whole search with densities instead of envelopes, here under the level that encloses nine tenths."""
    return branches(t, lambda known, rows: outside_densities(known, rows, 0.9))


def _new(t, name: str) -> str:
    return f"{dedup.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


FP = {"jd": "double", "filter": "string", "forcediffimflux": "double", "procstatus": "string"}
_FP_SQL = "fp AS (SELECT source_id, ra, dec, jd, band AS filter, CASE WHEN event_id % 7 = 0 THEN NULL ELSE flux END AS forcediffimflux, procstatus FROM epochs JOIN pos ON k = source_id)"


def _drops(t) -> str:
    """A folder with a forced-photometry file of each source: header, names, and a line for each epoch."""
    e = t.epochs.join(t.pos.select("k", "ra", "dec"), c("k") == c("source_id"))
    flux = F.when(c("event_id") % 7 == 0, "null").otherwise(c("flux").cast("string"))
    head = e.select("source_id", "ra", "dec").distinct()
    texts = [F.concat(F.lit("# Requested input R.A. = "), c("ra").cast("string"), F.lit(" degrees")), F.concat(F.lit("# Requested input Dec. = "), c("dec").cast("string"), F.lit(" degrees")), F.lit("index, jd, filter, forcediffimflux, procstatus,")]
    lines = head.select("source_id", F.posexplode(F.array(*texts)).alias("i", "value")).withColumn("i", c("i").cast("long"))
    body = e.select("source_id", (c("event_id") + 3).alias("i"), F.concat_ws(" ", c("event_id").cast("string"), c("jd").cast("string"), "band", flux, "procstatus").alias("value"))
    folder = _new(t, "drops")
    files.sink_texts(lines.union(body), folder, "source_id", "i")
    return folder


def _source_of(path):
    return F.regexp_extract(path, r"source_id=(\d+)", 1).cast("long").alias("source_id")


@query(f"WITH {_FP_SQL} SELECT * FROM fp")
def scan_fp_text(t):
    rows = files.scan_fp_text(t.spark, _drops(t) + "/*", FP)
    return rows.select(_source_of(c("path")), "ra", "dec", *FP)


@query(f"WITH {_FP_SQL} SELECT DISTINCT source_id, ra, dec FROM fp")
def fp_index(t):
    return files.fp_index(t.spark, _drops(t) + "/*").select(_source_of(c("path")), "ra", "dec")


@query(f"WITH {_FP_SQL} SELECT source_id, count(*) AS n FROM fp GROUP BY 1 HAVING count(*) <= 66")
def incremental_load(t):
    """Files that the table of finished ones lacks; finished are those of sources with more than 66 epochs."""
    rows = files.scan_fp_text(t.spark, _drops(t) + "/*", {"jd": "double"})
    counts = dedup.kept(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")))
    return files.unseen(counts, counts.filter("n > 66")).select(_source_of(c("path")), "n")


@query("SELECT src_id, band, fieldid, psf_mag, CAST(psf_flag AS BIGINT) AS psf_flag, 'q' || qid AS name FROM cat_a")
def sink_table(t):
    """Written by field and read again: ids are nullable longs, binary columns text."""
    path = _new(t, "catalogue")
    a = t.cat_a.select("src_id", "band", "fieldid", "psf_mag", c("psf_flag").cast("double").alias("psf_flag"), F.concat(F.lit("q"), c("qid").cast("string")).cast("binary").alias("name"))
    files.sink_table(a.repartition("fieldid"), path, ("fieldid",), ("psf_flag",))
    return files.scan_table(t.spark, path).select("src_id", "band", c("fieldid").cast("long").alias("fieldid"), "psf_mag", "psf_flag", "name")


@query("SELECT fieldid, count(DISTINCT (ccdid, qid)) FILTER (WHERE band = 'g') AS g, count(DISTINCT (ccdid, qid)) FILTER (WHERE band = 'i') AS i, count(DISTINCT (ccdid, qid)) FILTER (WHERE band = 'r') AS r FROM cat_a GROUP BY 1")
def sink_extraction_json(t):
    """How many quadrants were merged of each field and band, as JSON lines."""
    path = _new(t, "extraction")
    n = t.cat_a.groupBy("fieldid").agg(*[F.count_distinct(F.when(c("band") == b, F.concat_ws("_", "ccdid", "qid"))).alias(b) for b in "gir"])
    files.sink_json(n, path)
    return t.spark.read.schema(n.schema).json(path)


@query("SELECT obj_id, ra, dec, mag FROM cat_b")
def convert_format(t):
    """Space-delimited text tables to Parquet; what is converted already is left alone."""
    text, out = _new(t, "text"), _new(t, "converted")
    t.cat_b.select("obj_id", "ra", "dec", "mag", (c("fieldid") % 2).alias("part")).write.partitionBy("part").csv(text, sep=" ", header=True)
    schema = "obj_id long, ra double, dec double, mag double"
    for _ in range(2):
        files.convert(t.spark, {f"{text}/part={p}": f"{out}/part={p}" for p in (0, 1)}, schema)
    return t.spark.read.parquet(f"{out}/part=0", f"{out}/part=1").select("obj_id", "ra", "dec", "mag")


def _drained(stream: DataFrame, t, mode: str) -> DataFrame:
    """What a stream's last batch gave (complete mode), or all its batches (append), written and read again."""
    path, checkpoint = _new(t, "stream"), _new(t, "stream-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def _epoch_stream(t) -> DataFrame:
    path = _new(t, "epochs")
    e = t.epochs.withColumn("ts", F.timestamp_seconds(F.round((c("jd") - 2440587.5) * 86400.0)))
    e.write.parquet(path)
    return t.spark.readStream.schema(e.schema).parquet(path)


@query(f"WITH {_FP_SQL} SELECT DISTINCT ra, dec, jd, filter, forcediffimflux FROM fp")
def stream_fp_ingest(t):
    folder = _drops(t)
    return _drained(jobs.fp_ingest(t.spark, folder + "/*", FP), t, "append").select("ra", "dec", "jd", "filter", "forcediffimflux")


_TS = "CAST(round((jd - 2440587.5) * 86400) AS BIGINT)"


@query(f"""WITH s AS (SELECT *, {_TS} AS sec FROM epochs), w AS (SELECT *, unnest(range(sec // 432000 - 1, sec // 432000 + 1)) AS k FROM s)
SELECT source_id, band, k * 432000 AS start, round(sum(flux / (flux_unc * flux_unc)) / sum(1 / (flux_unc * flux_unc)), 6) AS flux, round(1 / sqrt(sum(1 / (flux_unc * flux_unc))), 6) AS unc, count(*) AS n FROM w GROUP BY ALL""")
def stream_window_stack(t):
    out = _drained(jobs.window_stack(_epoch_stream(t)), t, "complete")
    return out.select("source_id", "band", F.unix_seconds("start").alias("start"), r6(c("stack_flux")).alias("flux"), r6(c("stack_unc")).alias("unc"), "n")


@query(f"""WITH s AS (SELECT source_id, {_TS} AS sec, event_id FROM epochs), b AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY source_id ORDER BY sec, event_id) >= 259200 THEN 1 ELSE 0 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY sec, event_id) AS e FROM b) SELECT source_id, min(sec) AS first, max(sec) AS last, count(*) AS n FROM g GROUP BY source_id, e""")
def stream_epoch_split(t):
    """Observing epochs by gaps of three days, as the derived series span a month."""
    out = _drained(jobs.epoch_split(_epoch_stream(t), "3 days"), t, "complete")
    return out.select("source_id", F.unix_seconds("first_ts").alias("first"), F.unix_seconds("last_ts").alias("last"), "n")


@query("""WITH RECURSIVE o AS (SELECT source_id, band, jd, event_id, flux, row_number() OVER (PARTITION BY source_id, band ORDER BY jd, event_id) AS i FROM epochs),
w AS (SELECT source_id, band, i, jd, flux, jd AS t0 FROM o WHERE i = 1 UNION ALL SELECT o.source_id, o.band, o.i, o.jd, o.flux, CASE WHEN o.jd < w.t0 + 3 THEN w.t0 ELSE o.jd END FROM w JOIN o ON o.source_id = w.source_id AND o.band = w.band AND o.i = w.i + 1)
SELECT source_id, band, round(t0, 6) AS t0, round(avg(jd), 6) AS mean_jd, round(avg(flux), 6) AS mean_flux, count(*) AS n FROM w GROUP BY source_id, band, t0""")
def stream_anchored_windows(t):
    """Windows that each series anchors, from files that arrive in no order; a last epoch, years later, moves the watermark past them."""
    path = _new(t, "epochs")
    e = t.epochs.select("source_id", "band", "jd", "flux", F.timestamp_micros(F.round((c("jd") - 2440587.5) * 86400e6).cast("long")).alias("ts"))
    e.repartition(4, F.rand(5)).write.parquet(path)
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("source_id"), F.lit("end").alias("band"), F.lit(0.0).alias("jd"), F.lit(0.0).alias("flux"), (c("ts") + F.expr("interval 3000 days")).alias("ts"))
    end.select(*e.columns).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = _drained(jobs.anchored_windows(stream, ["source_id", "band"], 3.0), t, "append").filter("band <> 'end'")
    return out.select("source_id", "band", *[r6(c(x)).alias(x) for x in ("t0", "mean_jd", "mean_flux")], "n")


@query(_funnel_sql("band"))
def stream_filter_funnel(t):
    source, out, checkpoint = _new(t, "matched"), _new(t, "funnel"), _new(t, "funnel-checkpoint")
    t.matched.repartition(4).write.parquet(source)
    stream = t.spark.readStream.schema(t.matched.schema).option("maxFilesPerTrigger", 2).parquet(source)
    jobs.filter_funnel(stream, CHAIN, ["band"], out, checkpoint).awaitTermination()
    return jobs.running_funnel(t.spark, out, ["band"]).select("band", "stage", "filter", "n_before", "n_after")
