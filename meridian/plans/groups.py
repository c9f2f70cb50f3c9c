"""Queries that group, choose, count or compare: deduplication, funnels, audits, recovery, set operations, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import photometry as P
from ..operators import dedup, filters, ranking
from .registry import query
from .scalars import SNR_A, SNR_B, SNR_BOTH

c = F.col
CHAIN = ["extraction", "shape", "not_saturated", "psf_fit", "dec_above", "snr_both"]


def r6(x):
    return F.round(x, 6)


@query("SELECT fieldid, ccdid, min_by(psf_mag, src_id) FILTER (WHERE psf_flag IS NULL) AS mag FROM cat_a GROUP BY ALL")
def first_valid(t):
    return t.cat_a.groupBy("fieldid", "ccdid").agg(dedup.first_valid(F.when(c("psf_flag").isNull(), c("psf_mag")), "src_id").alias("mag"))


@query("SELECT obj_id, min_by(mag, -primary_detection) FILTER (WHERE mag IS NOT NULL) AS mag, max(primary_detection) AS primary_detection, min_by(fieldid, -primary_detection) AS fieldid, round(min_by(dec, -primary_detection), 6) AS dec FROM cat_b_dup GROUP BY obj_id")
def collapse_duplicates(t):
    """First by place, then by id: of each column the first value in order of detection that isn't NULL."""
    order = -c("primary_detection")
    def collapsed(df, *by):
        return df.groupBy(*by).agg(*[dedup.first_valid(x, order).alias(x) for x in ("mag", "fieldid", *({"ra", "dec"} - set(by)))], F.max("primary_detection").alias("primary_detection"))
    return collapsed(collapsed(t.cat_b_dup, "obj_id", "ra", "dec"), "obj_id").select("obj_id", "mag", "primary_detection", "fieldid", r6(c("dec")).alias("dec"))


@query("SELECT obj_id, mag FROM cat_b_dup QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY primary_detection DESC) = 1")
def dedup_primary(t):
    return dedup.best_row(t.cat_b_dup, ["obj_id"], [c("primary_detection").desc()]).select("obj_id", "mag")


@query("SELECT k, src_id FROM cat_a QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN sep_flag = 0 THEN 0 ELSE 1 END, psf_err DESC, src_id) = 1")
def dedup_primary_flag(t):
    return dedup.best_row(t.cat_a, ["k"], [F.when(c("sep_flag") == 0, 0).otherwise(1), c("psf_err").desc(), c("src_id")]).select("k", "src_id")


@query("SELECT fieldid, ccdid, qid, min(src_id) AS src_id FROM cat_a GROUP BY ALL")
def unique_keep_first(t):
    return dedup.best_row(t.cat_a, ["fieldid", "ccdid", "qid"], [c("src_id")]).select("fieldid", "ccdid", "qid", "src_id")


@query("SELECT obj_id, primary_detection, row_number() OVER (PARTITION BY obj_id ORDER BY primary_detection DESC) AS rn FROM cat_b_dup")
def rank_primary(t):
    return t.cat_b_dup.select("obj_id", "primary_detection", F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("primary_detection"))).cast("long").alias("rn"))


@query("SELECT k, count(DISTINCT band) AS n_bands, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM cat_a GROUP BY k HAVING count(DISTINCT band) >= 2")
def n_bands(t):
    bands = F.array_sort(F.collect_set("band"))
    return t.cat_a.groupBy("k").agg(F.count_distinct("band").alias("n_bands"), F.concat_ws(",", bands).alias("bands")).filter("n_bands >= 2")


_PASS = """f AS (SELECT band, fieldid, catalog_flag, src_id, coalesce((CAST(sep_flag AS BIGINT) & 252) = 0, false) AS p1, coalesce(a / b < 2 AND (a / b < 1.35 OR npix < 200), false) AS p2,
    (coalesce(info_flag, 0) & 4224) = 0 AND (coalesce(info_flag2, 0) & 4096) = 0 AND psf_mag > 13.5 AS p3, psf_flag IS NULL OR psf_flag = 0 AS p4, dec > -29.5 AS p5,
    """ + SNR_BOTH + """ AS p6 FROM matched)"""
_STEPS = [("true", "p1"), ("p1", "p1 AND p2"), ("p1 AND p2", "p1 AND p2 AND p3"), ("p1 AND p2 AND p3", "p1 AND p2 AND p3 AND p4"), ("p1 AND p2 AND p3 AND p4", "p1 AND p2 AND p3 AND p4 AND p5"), ("p1 AND p2 AND p3 AND p4 AND p5", "p1 AND p2 AND p3 AND p4 AND p5 AND p6")]


def _funnel_sql(by: str) -> str:
    return "WITH " + _PASS + " " + " UNION ALL ".join(f"SELECT {by}, {i} AS stage, '{CHAIN[i - 1]}' AS filter, count(*) FILTER (WHERE {x}) AS n_before, count(*) FILTER (WHERE {y}) AS n_after FROM f GROUP BY {by}" for i, (x, y) in enumerate(_STEPS, 1))


_BANDS = "VALUES ('g'), ('r'), ('i'), ('gri'), ('gr'), ('gi'), ('ri')"
_FUNNEL = (
    "deep AS (SELECT src_id // 10 AS k, catalog_flag, band, CASE WHEN NOT p1 THEN 0 WHEN NOT p2 THEN 1 WHEN NOT p3 THEN 2 WHEN NOT p4 THEN 3 WHEN NOT p5 THEN 4 WHEN NOT p6 THEN 5 ELSE 6 END AS d FROM f), st AS (SELECT unnest(range(0, 7)) AS stage), "
    "alive AS (SELECT k, catalog_flag, stage, coalesce(string_agg(band, '' ORDER BY CASE band WHEN 'g' THEN 1 WHEN 'r' THEN 2 ELSE 3 END) FILTER (WHERE d >= stage), '') AS alive FROM deep, st GROUP BY ALL), "
    f"n AS (SELECT catalog_flag, stage, b.bands, count(*) FILTER (WHERE CASE WHEN len(b.bands) = 1 THEN contains(alive, b.bands) ELSE alive = b.bands END) AS n FROM alive, ({_BANDS}) b(bands) GROUP BY ALL)"
)


@query("WITH " + _PASS + ", " + _FUNNEL + f" SELECT a.catalog_flag, a.stage, {CHAIN!r}[a.stage] AS filter, a.bands, b.n AS n_before, a.n AS n_after FROM n a JOIN n b ON b.catalog_flag = a.catalog_flag AND b.bands = a.bands AND b.stage = a.stage - 1")
def funnel_stats(t):
    return filters.band_funnel(t.matched, CHAIN, "k", ["catalog_flag"])


@query("WITH " + _PASS + " SELECT stage, filter, CAST(sum(n_before) AS BIGINT) AS n_before, CAST(sum(n_after) AS BIGINT) AS n_after FROM (" + _funnel_sql("fieldid").split(_PASS)[1] + ") GROUP BY ALL")
def combine_stats(t):
    return filters.summed(filters.funnel(t.matched, CHAIN, ["fieldid"]), "fieldid")


@query("WITH " + _PASS + " SELECT band, stage, round(n_after / first_value(n_before) OVER (PARTITION BY band ORDER BY stage), 6) AS fraction FROM (" + _funnel_sql("band").split(_PASS)[1] + ")")
def funnel_fractions(t):
    w = Window.partitionBy("band").orderBy("stage")
    return filters.funnel(t.matched, CHAIN, ["band"]).select("band", "stage", r6(c("n_after") / F.first("n_before").over(w)).alias("fraction"))


@query("WITH " + _PASS + " SELECT src_id, CASE WHEN NOT p1 THEN 'extraction' WHEN NOT p2 THEN 'shape' WHEN NOT p3 THEN 'not_saturated' WHEN NOT p4 THEN 'psf_fit' WHEN NOT p5 THEN 'dec_above' WHEN NOT p6 THEN 'snr_both' END AS reject_reason FROM f")
def rejection_log(t):
    return filters.flagged(t.matched, CHAIN).select("src_id", "reject_reason")


@query("WITH " + _PASS + " SELECT src_id FROM f WHERE p1 AND p3 AND p4 AND p5 AND p6 AND NOT p2")
def ablation_diff(t):
    def passing(names):
        out = filters.flagged(t.matched, names)
        return out.filter("reject_reason is null").select("src_id")
    return passing([n for n in CHAIN if n != "shape"]).join(passing(CHAIN), "src_id", "left_anti")


@query("WITH " + _PASS + " SELECT k.src_id // 10 AS k, reason AS filter FROM (SELECT src_id, CASE WHEN NOT p1 THEN 'extraction' WHEN NOT p2 THEN 'shape' WHEN NOT p4 THEN 'psf_fit' END AS reason FROM f) k WHERE reason IS NOT NULL GROUP BY ALL HAVING count(DISTINCT k.src_id) = 3")
def rejected_in_all_bands(t):
    log = filters.flagged(t.matched, ["extraction", "shape", "psf_fit"]).filter("reject_reason is not null")
    return log.groupBy("k", c("reject_reason").alias("filter")).agg(F.count_distinct("band").alias("n")).filter("n = 3").select("k", "filter")


@query(f"SELECT src_id, unnest(list_filter([CASE WHEN catalog_flag = 1 OR {SNR_A} THEN 1 END, CASE WHEN {SNR_B} THEN 2 END, CASE WHEN catalog_flag = 0 AND {SNR_BOTH} THEN 0 END], lambda x: x IS NOT NULL)) AS branch FROM matched")
def reroute_low_snr(t):
    """Rows that one survey alone sees with confidence go to its branch; by different magnitudes a row can go to both."""
    one = (c("catalog_flag") == 1) | filters.snr_a_only()
    both = (c("catalog_flag") == 0) & filters.snr_both()
    return t.matched.select("src_id", F.explode(F.array_compact(F.array(F.when(both, 0), F.when(one, 1), F.when(filters.snr_b_only(), 2)))).alias("branch"))


@query("SELECT fieldid, band, count(*) AS n, count(DISTINCT (ccdid, qid)) AS quadrants, round(count(DISTINCT (ccdid, qid)) * 0.73, 6) AS area FROM cat_a GROUP BY ALL")
def quadrant_counts(t):
    q = t.cat_a.groupBy("fieldid", "band").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ccdid", "qid").alias("quadrants"))
    return q.withColumn("area", r6(c("quadrants") * 0.73))


_VALID = "npix > 350 AND psf_flag IS NOT NULL"
_AUDIT = f"audit AS (SELECT fieldid, ccdid, qid, concat_ws(',', CASE WHEN count(*) FILTER (WHERE band = 'g' AND {_VALID}) = 0 THEN 'g' END, CASE WHEN count(*) FILTER (WHERE band = 'i' AND {_VALID}) = 0 THEN 'i' END, CASE WHEN count(*) FILTER (WHERE band = 'r' AND {_VALID}) = 0 THEN 'r' END) AS missing FROM cat_a GROUP BY ALL)"


def _audit(t):
    """Bands of each quadrant's table without a single value. A quadrant with an empty table is complete."""
    valid = lambda b: F.count(F.when((c("band") == b) & (c("npix") > 350) & c("psf_flag").isNotNull(), 1)) == 0
    return t.cat_a.groupBy("fieldid", "ccdid", "qid").agg(F.array_compact(F.array(*[F.when(valid(b), b) for b in "gir"])).alias("missing"))


@query(f"WITH {_AUDIT} SELECT DISTINCT p.fieldid, p.ccdid, p.qid, coalesce(missing, '') AS missing FROM pos p LEFT JOIN audit USING (fieldid, ccdid, qid)")
def completeness_audit(t):
    expected = t.pos.select("fieldid", "ccdid", "qid").distinct()
    return expected.join(_audit(t), ["fieldid", "ccdid", "qid"], "left").select("fieldid", "ccdid", "qid", F.concat_ws(",", F.coalesce("missing", F.array().cast("array<string>"))).alias("missing"))


@query(f"""WITH {_AUDIT}, img AS (SELECT fieldid, ccdid, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM cat_a WHERE npix > 200 GROUP BY ALL), b AS (SELECT DISTINCT fieldid, ccdid, qid FROM cat_b WHERE info_flag = 128)
SELECT fieldid, ccdid, qid, CASE WHEN b.qid IS NULL THEN bands ELSE array_to_string(list_filter(string_split(missing, ','), lambda x: contains(bands, x) AND x <> ''), ',') END AS redo FROM audit JOIN img USING (fieldid, ccdid) LEFT JOIN b USING (fieldid, ccdid, qid)
WHERE b.qid IS NULL OR len(list_filter(string_split(missing, ','), lambda x: contains(bands, x) AND x <> '')) > 0""")
def requeue_plan(t):
    """Missing bands for which there are images; all of these where the quadrant's table of survey B is missing."""
    images = t.cat_a.filter("npix > 200").groupBy("fieldid", "ccdid").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    there = t.cat_b.filter("info_flag = 128").select("fieldid", "ccdid", "qid").distinct().withColumn("there", F.lit(True))
    j = _audit(t).join(images, ["fieldid", "ccdid"]).join(there, ["fieldid", "ccdid", "qid"], "left")
    redo = F.when(c("there"), F.array_intersect("missing", "bands")).otherwise(c("bands"))
    return j.select("fieldid", "ccdid", "qid", redo.alias("redo")).filter(F.size("redo") > 0).withColumn("redo", F.concat_ws(",", "redo"))


_RANGE = """SELECT fieldid, CASE WHEN max(ra) - min(ra) > 180 THEN min(ra) FILTER (WHERE ra >= 180) ELSE min(ra) END AS ra_lo, CASE WHEN max(ra) - min(ra) > 180 THEN max(ra) FILTER (WHERE ra < 180) + 360 ELSE max(ra) END AS ra_hi,
min(dec) AS dec_lo, max(dec) AS dec_hi FROM {} GROUP BY fieldid"""


def ranges(df):
    """Range of positions in each field; the RA of one that lies across 0 goes from lo to hi + 360."""
    wraps = F.max("ra") - F.min("ra") > 180
    lo = F.when(wraps, F.min(F.when(c("ra") >= 180, c("ra")))).otherwise(F.min("ra"))
    hi = F.when(wraps, F.max(F.when(c("ra") < 180, c("ra"))) + 360.0).otherwise(F.max("ra"))
    return df.groupBy("fieldid").agg(lo.alias("ra_lo"), hi.alias("ra_hi"), F.min("dec").alias("dec_lo"), F.max("dec").alias("dec_hi"))


@query(f"SELECT fieldid, round(ra_lo, 6) AS ra_lo, round(ra_hi, 6) AS ra_hi, round(dec_lo, 6) AS dec_lo, round(dec_hi, 6) AS dec_hi FROM ({_RANGE.format('pos')})")
def coord_range(t):
    return ranges(t.pos).select("fieldid", *[r6(c(x)).alias(x) for x in ("ra_lo", "ra_hi", "dec_lo", "dec_hi")])


@query("SELECT fieldid, band, max_by(src_id, npix * 1000000 - src_id) AS src_id FROM cat_a GROUP BY ALL")
def best_image(t):
    return t.cat_a.groupBy("fieldid", "band").agg(F.max_by("src_id", c("npix") * 1000000 - c("src_id")).alias("src_id"))


@query("SELECT 14 + (CAST(floor(psf_mag) AS BIGINT) - 14) AS bin, count(*) AS n FROM cat_a WHERE psf_mag >= 14 AND psf_mag < 24 GROUP BY 1")
def histogram(t):
    return t.cat_a.filter("psf_mag >= 14 and psf_mag < 24").groupBy((13 + F.width_bucket("psf_mag", F.lit(14.0), F.lit(24.0), F.lit(10))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def type_tally(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT band, round(avg(psf_mag - kron_mag), 6) AS mean_colour, round(quantile_cont(psf_mag - kron_mag, 0.5), 6) AS median_colour, round(avg(CASE WHEN psf_mag - kron_mag > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share FROM cat_a WHERE psf_err < 0.1 GROUP BY band")
def colour_stats(t):
    colour = c("psf_mag") - c("kron_mag")
    return t.cat_a.filter("psf_err < 0.1").groupBy("band").agg(r6(F.avg(colour)).alias("mean_colour"), r6(F.percentile(colour, 0.5)).alias("median_colour"), r6(F.avg((colour > 0.8).cast("double"))).alias("share"))


@query("WITH s AS (SELECT band, CAST(floor(m) AS BIGINT) AS bin, src_id, psf_mag - m AS d FROM cat_a), g AS (SELECT band, bin, avg(d) AS mu, stddev_pop(d) AS sd FROM s GROUP BY ALL) SELECT src_id FROM s JOIN g USING (band, bin) WHERE abs(d - mu) > 3 * sd")
def nsigma_bins(t):
    s = t.cat_a.select("src_id", "band", F.floor("m").alias("bin"), (c("psf_mag") - c("m")).alias("d"))
    g = s.groupBy("band", "bin").agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"))
    return s.join(g, ["band", "bin"]).filter(F.abs(c("d") - c("mu")) > 3 * c("sd")).select("src_id")


_LIMITED = "abs(psf_mag - CASE WHEN mag IS NULL THEN CASE band WHEN 'g' THEN 23.3e0 WHEN 'r' THEN 23.2e0 ELSE 23.1e0 END ELSE mag END)"


@query(f"SELECT k, round(avg({_LIMITED}), 6) AS mean_dmag, round(max({_LIMITED}) FILTER (WHERE band = 'g'), 6) AS g, round(max({_LIMITED}) FILTER (WHERE band = 'r'), 6) AS r, round(max({_LIMITED}) FILTER (WHERE band = 'i'), 6) AS i, row_number() OVER (ORDER BY round(avg({_LIMITED}), 6) DESC NULLS LAST, k) AS rank FROM matched GROUP BY k")
def rank_by_dmag(t):
    a, b = P.effective_mags(F.when(c("mag").isNull(), 1).otherwise(0))
    d = F.abs(a - b)
    g = t.matched.groupBy("k").agg(r6(F.avg(d)).alias("mean_dmag"), *[r6(F.max(F.when(c("band") == x, d))).alias(x) for x in "gri"])
    return ranking.ranked(g, [F.desc_nulls_last("mean_dmag"), F.asc("k")])


@query("SELECT source_id, count(*) AS n FROM epochs GROUP BY 1 ORDER BY n DESC, source_id LIMIT 1")
def most_observed(t):
    return t.epochs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_id").limit(1)


@query("SELECT k, m FROM pos ORDER BY m DESC, k LIMIT 10")
def top_n(t):
    return t.pos.select("k", "m").orderBy(F.desc("m"), "k").limit(10)


@query("SELECT fieldid FROM cat_a WHERE band = 'g' INTERSECT SELECT fieldid FROM cat_a WHERE band = 'r' AND dec > 0 INTERSECT SELECT fieldid FROM cat_a WHERE band = 'i'")
def intersect_fields(t):
    a = t.cat_a
    return a.filter("band = 'g'").select("fieldid").intersect(a.filter("band = 'r' and dec > 0").select("fieldid")).intersect(a.filter("band = 'i'").select("fieldid"))


@query("SELECT k FROM cat_a WHERE band = 'g' EXCEPT SELECT k FROM cat_a WHERE band = 'r'")
def except_sets(t):
    return t.cat_a.filter("band = 'g'").select("k").distinct().subtract(t.cat_a.filter("band = 'r'").select("k"))


@query("SELECT fieldid, ccdid, qid FROM cat_b EXCEPT SELECT fieldid, ccdid, qid FROM masked")
def missing_quadrants(t):
    return t.cat_b.select("fieldid", "ccdid", "qid").subtract(t.masked.select("fieldid", "ccdid", "qid"))


@query("SELECT k FROM cat_a WHERE band = 'g' UNION SELECT k FROM cat_a WHERE band = 'r'")
def union_distinct(t):
    return t.cat_a.filter("band = 'g'").select("k").union(t.cat_a.filter("band = 'r'").select("k")).distinct()


@query("SELECT src_id, ra, dec, psf_mag, NULL::DOUBLE AS mag FROM cat_a UNION ALL SELECT obj_id, ra, dec, NULL, mag FROM cat_b")
def vstack_union(t):
    return t.cat_a.select("src_id", "ra", "dec", "psf_mag").unionByName(t.cat_b.select(c("obj_id").alias("src_id"), "ra", "dec", "mag"), allowMissingColumns=True)


@query("SELECT src_id AS id, ra, dec FROM cat_a UNION ALL SELECT obj_id, ra, dec FROM cat_b")
def add_sources(t):
    """Two collections one after the other, repeats kept."""
    return t.cat_a.select(c("src_id").alias("id"), "ra", "dec").union(t.cat_b.select("obj_id", "ra", "dec"))


@query("WITH " + _PASS + " SELECT fieldid, count(*) AS n, string_agg(DISTINCT band, ',' ORDER BY band) AS bands FROM f WHERE p1 AND p2 AND p3 AND p4 AND p5 AND p6 AND catalog_flag = 1 GROUP BY fieldid")
def combine_fields(t):
    """What is left of each field after all filters, stacked; fields without a row are dropped."""
    left = filters.flagged(t.matched.filter("catalog_flag = 1"), CHAIN).filter("reject_reason is null")
    return left.groupBy("fieldid").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("band"))).alias("bands"))


@query("SELECT vec_id, CAST(floor((wavelength - lo) / 40) AS BIGINT) AS bin, round(avg(wavelength), 4) AS wavelength, round(avg(flux), 5) AS flux FROM (SELECT *, min(wavelength) OVER (PARTITION BY vec_id) AS lo FROM spectrum) GROUP BY ALL")
def bin_spectrum_width(t):
    s = t.spectrum.withColumn("lo", F.min("wavelength").over(Window.partitionBy("vec_id")))
    return s.groupBy("vec_id", F.floor((c("wavelength") - c("lo")) / 40).alias("bin")).agg(F.round(F.avg("wavelength"), 4).alias("wavelength"), F.round(F.avg("flux"), 5).alias("flux"))


@query("SELECT vec_id, run, round(avg(flux), 5) AS flux FROM (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY wavelength) - 1) // 7 AS run FROM spectrum) GROUP BY ALL HAVING count(*) = 7")
def bin_spectrum_count(t):
    rn = F.row_number().over(Window.partitionBy("vec_id").orderBy("wavelength"))
    s = t.spectrum.withColumn("run", F.floor((rn - 1) / 7))
    return s.groupBy("vec_id", "run").agg(F.round(F.avg("flux"), 5).alias("flux"), F.count(F.lit(1)).alias("n")).filter("n = 7").drop("n")


@query("SELECT vec_id, wavelength FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY wavelength) AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM spectrum WHERE NOT (wavelength > 7580 AND wavelength < 7680)) WHERE i > 5 AND i <= n - 4")
def telluric_trim(t):
    s = t.spectrum.filter(~((c("wavelength") > 7580) & (c("wavelength") < 7680)))
    w = Window.partitionBy("vec_id")
    s = s.withColumn("i", F.row_number().over(w.orderBy("wavelength"))).withColumn("n", F.count(F.lit(1)).over(w))
    return s.filter("i > 5 and i <= n - 4").select("vec_id", "wavelength")
