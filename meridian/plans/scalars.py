"""Queries on single rows: magnitudes, flags, names, schemas and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import photometry as P
from ..operators import filters, spatial
from ..operators.spatial import separation
from .registry import query

c = F.col


def r6(x):
    return F.round(x, 6)


@query("SELECT event_id, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) + zp END, 6) AS mag, round(CASE WHEN flux > 0 THEN 2.5 * flux_unc / (ln(10) * flux) END, 6) AS magerr FROM epochs")
def flux_to_mag(t):
    return t.epochs.select("event_id", r6(P.flux_to_mag(c("flux"), c("zp"))).alias("mag"), r6(P.flux_to_mag_err(c("flux"), c("flux_unc"))).alias("magerr"))


@query("SELECT src_id, round(pow(10, (psf_mag - 25) / -2.5), 6) AS flux, round(psf_err * ln(10) * pow(10, (psf_mag - 25) / -2.5) / 2.5, 6) AS flux_err FROM cat_a")
def mag_to_flux(t):
    f = P.mag_to_flux(c("psf_mag"), 25.0)
    return t.cat_a.select("src_id", r6(f).alias("flux"), r6(P.mag_to_flux_err(f, c("psf_err"))).alias("flux_err"))


@query("SELECT obj_id, round(CASE WHEN mag IS NOT NULL THEN 2.5 / ln(10) / magerr END, 6) AS snr FROM cat_b")
def snr_from_mag(t):
    return t.cat_b.select("obj_id", r6(P.snr(c("mag"), c("magerr"))).alias("snr"))


@query("SELECT event_id, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) + 8.9 END, 6) AS mag FROM epochs")
def mag_cols_ps(t):
    return t.epochs.select("event_id", r6(P.flux_to_mag(c("flux"), 8.9)).alias("mag"))


@query("SELECT event_id, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) + 25.801 END, 6) AS g, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) + 25.354 END, 6) AS bp, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) + 25.104 END, 6) AS rp, round(51544.5 + (2016 + event_id % 9 - 2000) * 365.25, 6) AS mjd FROM epochs")
def gaia_mags(t):
    return t.epochs.select("event_id", *[r6(P.flux_to_mag(c("flux"), z)).alias(b) for b, z in P.STAR_ZERO_POINTS.items()], r6(P.julian_year_to_mjd(2016.0 + c("event_id") % 9)).alias("mjd"))


@query("SELECT src_id, CASE WHEN psf_flag = 4 THEN mag_limit ELSE psf_mag END AS mag, coalesce(psf_flag = 4, false) AS upper_lim_flag FROM cat_a")
def upper_limit_fill(t):
    at_limit = P.holds(c("psf_flag") == 4)
    return t.cat_a.select("src_id", F.when(at_limit, c("mag_limit")).otherwise(c("psf_mag")).alias("mag"), at_limit.alias("upper_lim_flag"))


@query("SELECT src_id, first_value(CASE WHEN npix % 3 = 0 THEN mag_limit + band_rank END IGNORE NULLS) OVER (PARTITION BY fieldid, ccdid, qid, band ORDER BY src_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS quad_limit FROM cat_a")
def maglimit_broadcast(t):
    w = Window.partitionBy("fieldid", "ccdid", "qid", "band").orderBy("src_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.cat_a.select("src_id", F.first(F.when(c("npix") % 3 == 0, c("mag_limit") + c("band_rank")), ignorenulls=True).over(w).alias("quad_limit"))


_BRANCHED = "b AS (SELECT *, CASE WHEN catalog_flag = 0 AND src_id % 5 = 0 THEN 2 ELSE catalog_flag END AS flag FROM matched)"


@query(f"WITH {_BRANCHED} SELECT src_id, flag, CASE WHEN flag = 2 THEN mag_limit ELSE psf_mag END AS a_mag, CASE WHEN flag = 1 THEN CASE band WHEN 'g' THEN 23.3e0 WHEN 'r' THEN 23.2e0 ELSE 23.1e0 END ELSE mag END AS b_mag FROM b")
def effective_mags(t):
    branched = t.matched.withColumn("flag", F.when((c("catalog_flag") == 0) & (c("src_id") % 5 == 0), 2).otherwise(c("catalog_flag")))
    a, b = P.effective_mags(c("flag"))
    return branched.select("src_id", "flag", a.alias("a_mag"), b.alias("b_mag"))


@query("SELECT src_id, round((psf_mag + mag) / 2, 6) AS mean_mag, round(psf_mag - mag, 6) AS dmag, round(greatest(sqrt(psf_err * psf_err + magerr * magerr), 0.01), 6) AS err FROM matched WHERE mag IS NOT NULL")
def dmag_features(t):
    m = t.matched.filter("mag is not null")
    return m.select("src_id", r6((c("psf_mag") + c("mag")) / 2).alias("mean_mag"), r6(c("psf_mag") - c("mag")).alias("dmag"), r6(F.greatest(F.sqrt(c("psf_err") * c("psf_err") + c("magerr") * c("magerr")), F.lit(0.01))).alias("err"))


@query("SELECT src_id, (CAST(coalesce(sep_flag, 0) AS BIGINT) & 9) <> 0 AS flagged FROM cat_a")
def flag_any(t):
    return t.cat_a.select("src_id", P.any_bit(c("sep_flag"), 1, 8).alias("flagged"))


_TEXTS = [*P.SENTINELS, "0", "17.5", "nano", "-99"]
_SENT, _GIVEN = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]" for texts in (P.SENTINELS, _TEXTS))


@query(f"WITH r AS (SELECT event_id, {_GIVEN}[event_id % {len(_TEXTS)} + 1] AS note, CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -999e0 ELSE value END AS v FROM events) SELECT event_id, CASE WHEN NOT list_contains({_SENT}, note) THEN note END AS note, CASE WHEN NOT isnan(v) AND v <> -999 THEN v END AS v FROM r")
def sentinel_normalise(t):
    """Every spelling of a missing value becomes NULL, in texts and in numbers."""
    note = F.element_at(F.array(*map(F.lit, _TEXTS)), (c("event_id") % len(_TEXTS) + 1).cast("int"))
    v = F.when(c("event_id") % 4 == 0, float("nan")).when(c("event_id") % 4 == 1, -999.0).otherwise(c("value"))
    return P.normalised(t.events.select("event_id", note.alias("note"), v.alias("v")), ["note", "v"])


@query("SELECT CAST(obj_id AS BIGINT) + 9007199254740993 AS obj_id, CASE WHEN undetected THEN NULL ELSE mag END AS mag FROM cat_b")
def remove_mask(t):
    raw = t.cat_b.select((c("obj_id").cast("long") + F.lit(9007199254740993)).alias("obj_id"), F.coalesce("mag", F.lit(float("nan"))).alias("mag"))
    return raw.select("obj_id", P.clean(c("mag")).alias("mag"))


@query("SELECT obj_id AS B_obj_id, ra AS B_ra, dec AS B_dec, mag AS B_mag, ra, dec FROM cat_b")
def prefix_columns(t):
    b = t.cat_b.select("obj_id", "ra", "dec", "mag")
    return b.select(*[c(x).alias(x if x.startswith("B_") else f"B_{x}") for x in b.columns], "ra", "dec")


@query("SELECT obj_id AS catalog_id, ra AS right_ascension, dec AS declination FROM cat_b")
def rename_map(t):
    return t.cat_b.select("obj_id", "ra", "dec").withColumnsRenamed({"obj_id": "catalog_id", "ra": "right_ascension", "dec": "declination"})


@query("SELECT obj_id, ra, dec, mag, CAST(NULL AS DOUBLE) AS parallax, CAST(NULL AS DOUBLE) AS pm FROM cat_b")
def pad_schema(t):
    b = t.cat_b
    return b.select(*[c(x) if x in b.columns else F.lit(None).cast("double").alias(x) for x in ("obj_id", "ra", "dec", "mag", "parallax", "pm")])


@query("SELECT src_id, coalesce(mag, psf_mag, kron_mag) AS mag FROM matched")
def coalesce_columns(t):
    return t.matched.select("src_id", F.coalesce("mag", "psf_mag", "kron_mag").alias("mag"))


@query("SELECT k, translate(printf('%.4f_%.4f', ra, dec), '.-', 'pn') AS stem FROM pos")
def coord_stem(t):
    return t.pos.select("k", P.coord_stem(c("ra"), c("dec")).alias("stem"))


@query("SELECT k, round(ra, 4) AS ra, round(dec, 4) AS dec FROM pos UNION ALL SELECT -1, NULL, NULL")
def parse_coord_stem(t):
    stems = t.pos.select("k", F.concat(F.lit("12_"), P.coord_stem(F.round("ra", 4), F.round("dec", 4))).alias("stem")).union(t.spark.sql("select -1L, 'no stem'"))
    ra, dec = P.parse_coord_stem(c("stem"))
    return stems.select("k", F.round(ra, 4).alias("ra"), F.round(dec, 4).alias("dec"))


_PART = "substr(translate(CAST(CAST(round({x}, 4) AS DECIMAL(12, 4)) AS VARCHAR), '.-', 'pn'), 1, 6)"


@query(f"SELECT k, {_PART.format(x='ra')} || '_' || {_PART.format(x='dec')} AS box FROM pos")
def box_name(t):
    part = lambda x: F.substring(F.translate(F.round(x, 4).cast("decimal(12,4)").cast("string"), ".-", "pn"), 1, 6)
    return t.pos.select("k", F.concat_ws("_", part("ra"), part("dec")).alias("box"))


@query("SELECT k, round(CASE WHEN v = 0 THEN 0 ELSE floor(abs(v) * pow(10, 1 - floor(log10(abs(v)))) + 0.5) / pow(10, 1 - floor(log10(abs(v)))) END, 6) AS v FROM (SELECT k, m * (k % 1000) AS v FROM pos)")
def two_sig_figs(t):
    return t.pos.select("k", F.round(P.two_significant(c("m") * (c("k") % 1000)), 6).alias("v"))


@query("SELECT src_id, round(2 * asin(sqrt(pow(cos(radians(a.dec)) * cos(radians(a.ra)) - cos(radians(p.dec)) * cos(radians(p.ra)), 2) + pow(cos(radians(a.dec)) * sin(radians(a.ra)) - cos(radians(p.dec)) * sin(radians(p.ra)), 2) + pow(sin(radians(a.dec)) - sin(radians(p.dec)), 2)) / 2) * 180 * 3600 / pi(), 4) AS sep FROM cat_a a JOIN cat_b p ON a.k = p.obj_id")
def angular_sep(t):
    b = t.cat_b.select(c("obj_id").alias("k"), c("ra").alias("ra2"), c("dec").alias("dec2"))
    return t.cat_a.join(b, "k").select("src_id", F.round(separation(c("ra"), c("dec"), c("ra2"), c("dec2")), 4).alias("sep"))


_STEP = "SELECT star_id, fieldid, parallax_over_error, pmra, pmdec, pm_err, params_solved, radians(ra) AS ra_, radians(dec) AS de_, coalesce(pmra, 0) * (2021 - ref_epoch) * pi() / 648000000 AS ea, coalesce(pmdec, 0) * (2021 - ref_epoch) * pi() / 648000000 AS no FROM stars"
#: Stars at the epoch 2021, for the checks.
MOVED = f"""step AS ({_STEP}), vec AS (SELECT *, cos(de_) * cos(ra_) - ea * sin(ra_) - no * sin(de_) * cos(ra_) AS vx, cos(de_) * sin(ra_) + ea * cos(ra_) - no * sin(de_) * sin(ra_) AS vy, sin(de_) + no * cos(de_) AS vz FROM step),
moved AS (SELECT star_id, fieldid, parallax_over_error, pmra, pmdec, pm_err, params_solved, (degrees(atan2(vy, vx)) + 360) % 360 AS ra, degrees(asin(vz / sqrt(vx * vx + vy * vy + vz * vz))) AS dec FROM vec)"""


@query(f"WITH {MOVED} SELECT star_id, round(ra, 7) AS ra, round(dec, 7) AS dec FROM moved")
def propagate_pm(t):
    ra, dec = P.propagated(c("ra"), c("dec"), c("pmra"), c("pmdec"), 2021.0 - c("ref_epoch"))
    return t.stars.select("star_id", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


@query("SELECT src_id, round(sqrt(psf_err * psf_err + magerr * magerr), 6) AS color_err FROM matched")
def color_error(t):
    return t.matched.select("src_id", r6(F.sqrt(c("psf_err") * c("psf_err") + c("magerr") * c("magerr"))).alias("color_err"))


@query("SELECT k, CAST('1E-' || (15 + k % 4) AS DOUBLE) AS scale FROM pos")
def flux_unit_scale(t):
    unit = F.concat(F.lit("1E-"), (15 + c("k") % 4).cast("string"), F.lit(" erg/cm^2/s/Angstrom"))
    return t.pos.select("k", P.flux_unit_scale(unit).alias("scale"))


@query("SELECT src_id, CASE WHEN src_id % 2 = 0 THEN 'z' || band ELSE 'z' || band END AS code, lpad(CAST(fieldid AS VARCHAR), 6, '0') || '_' || lpad(CAST(ccdid AS VARCHAR), 2, '0') AS name FROM cat_a")
def filtercode_normalise(t):
    band = F.when(c("src_id") % 2 == 0, c("band")).otherwise(F.concat(F.lit("z"), c("band")))
    return t.cat_a.select("src_id", P.filter_code(band).alias("code"), F.concat_ws("_", F.lpad(c("fieldid").cast("string"), 6, "0"), F.lpad(c("ccdid").cast("string"), 2, "0")).alias("name"))


@query("""SELECT src_id, 'source ' || src_id || ' at ' || CAST(CAST(round(ra, 5) AS DECIMAL(8, 5)) AS VARCHAR) || ', ' || CAST(CAST(round(dec, 5) AS DECIMAL(8, 5)) AS VARCHAR) || '; band ' || band || '; match ' || coalesce(CAST(obj_id AS VARCHAR), 'none')
|| '; class ' || CASE WHEN a / b < 1.35 THEN 'star' ELSE 'galaxy' END || coalesce('; colour ' || CAST(CAST(round(psf_mag - kron_mag, 2) AS DECIMAL(8, 2)) AS VARCHAR), '') AS info FROM matched""")
def info_row(t):
    number = lambda x, n: F.round(x, n).cast(f"decimal(8,{n})").cast("string")
    parts = [
        F.concat(F.lit("source "), c("src_id").cast("string"), F.lit(" at "), number("ra", 5), F.lit(", "), number("dec", 5)), F.concat(F.lit("band "), "band"),
        F.concat(F.lit("match "), F.coalesce(c("obj_id").cast("string"), F.lit("none"))), F.concat(F.lit("class "), F.when(F.try_divide("a", "b") < 1.35, "star").otherwise("galaxy")),
        F.concat(F.lit("colour "), number(c("psf_mag") - c("kron_mag"), 2)),
    ]
    return t.matched.select("src_id", F.concat_ws("; ", *parts).alias("info"))


#: query -> filter, its options and the same predicate in SQL
ROW_FILTERS = {
    "catalog_filter": ("catalog", {}, "catalog_flag IN (0, 1, 2)"),
    "psf_fit_filter": ("psf_fit", {}, "psf_flag IS NULL OR psf_flag = 0"),
    "sep_extraction_filter": ("extraction", {}, "(CAST(sep_flag AS BIGINT) & 252) = 0"),
    "extended_source_artifact_filter": ("not_extended_artifact", {}, "NOT ((CAST(sep_flag AS BIGINT) & 1) <> 0 AND coalesce(psf_mag - kron_mag > 1.5, false))"),
    "shape_filter": ("shape", {}, "a IS NULL OR (a / b < 2 AND (a / b < 1.35 OR npix < 200))"),
    "snr_filter_any": ("snr_any", {}, "greatest(2.5 / ln(10) / psf_err, CASE WHEN mag IS NOT NULL THEN 2.5 / ln(10) / magerr END, 2.5 / ln(10) / kron_err, CASE WHEN b_kron_mag IS NOT NULL THEN 2.5 / ln(10) / b_kron_err END) > 5"),
    "dec_greater_than": ("dec_above", {"limit": -10.0}, "dec > -10"),
    "pstarr_not_saturated": ("not_saturated", {}, "(coalesce(info_flag, 0) & 4224) = 0 AND (coalesce(info_flag2, 0) & 4096) = 0 AND psf_mag > 13.5"),
    "pstarr_quality_filter": ("quality", {}, "NOT ((coalesce(quality_flag, 0) & 131) <> 0 OR (coalesce(obj_info_flag, 0) & 1098907648) <> 0)"),
    "drop_bad_detections": ("good_detection", {}, "(coalesce(info_flag, 0) & 2048) = 0 AND (coalesce(info_flag2, 0) & 4) = 0"),
}


def _row_filter(key: str, name: str, options: dict, sql: str) -> None:
    @query(f"SELECT src_id, coalesce({sql}, false) AS keep FROM matched", key)
    def run(t):
        return t.matched.select("src_id", filters.FILTERS[name](**options).alias("keep"))


for _key, (_name, _options, _sql) in ROW_FILTERS.items():
    _row_filter(_key, _name, _options, _sql)


_SA, _SB, _KA, _KB = "2.5 / ln(10) / psf_err", "CASE WHEN mag IS NOT NULL THEN 2.5 / ln(10) / magerr END", "2.5 / ln(10) / kron_err", "CASE WHEN b_kron_mag IS NOT NULL THEN 2.5 / ln(10) / b_kron_err END"
#: Whether both surveys, or the first or the second alone, see a row, for the checks.
SNR_BOTH = f"coalesce(({_SA} > 5 AND coalesce({_SB} > 5, true)) OR ({_KA} > 5 AND coalesce({_KB} > 5, true)), false)"
SNR_A, SNR_B = f"(NOT {SNR_BOTH} AND ({_SA} > 5 OR {_KA} > 5))", f"(NOT {SNR_BOTH} AND (coalesce({_SB} > 5, false) OR coalesce({_KB} > 5, false)))"


@query(f"SELECT src_id, {SNR_BOTH} AS keep, {SNR_A} AS a_only, {SNR_B} AS b_only FROM matched")
def snr_filter_both(t):
    return t.matched.select("src_id", filters.snr_both().alias("keep"), filters.snr_a_only().alias("a_only"), filters.snr_b_only().alias("b_only"))


@query("SELECT k, bool_and(coalesce(mag > 0 AND mag < CASE band WHEN 'g' THEN 20 WHEN 'r' THEN 19.5 ELSE 19 END, false)) AND count(DISTINCT band) = 3 AS keep FROM matched GROUP BY k")
def pstarr_mag_less_than(t):
    bright = F.create_map(F.lit("g"), F.lit(20.0), F.lit("r"), F.lit(19.5), F.lit("i"), F.lit(19.0))[c("band")]
    good = F.coalesce((c("mag") > 0) & (c("mag") < bright), F.lit(False))
    return t.matched.groupBy("k").agg((F.bool_and(good) & (F.count_distinct("band") == 3)).alias("keep"))


@query("SELECT event_id FROM epochs WHERE list_bool_and(list_transform(string_split(procstatus, ','), lambda x: x IN ('0', '56')))")
def procstatus_filter(t):
    return t.epochs.filter(F.forall(F.split("procstatus", ","), lambda x: x.isin("0", "56"))).select("event_id")


@query("SELECT event_id, CASE WHEN flux > 0 AND flux / flux_unc >= 3 THEN 'detection' ELSE 'limit' END AS kind FROM epochs")
def detection_split(t):
    return t.epochs.select("event_id", F.when((c("flux") > 0) & (c("flux") / c("flux_unc") >= 3), "detection").otherwise("limit").alias("kind"))


@query("SELECT event_id, jd FROM epochs WHERE band = 'r' AND jd BETWEEN 2460315 AND 2460325")
def band_select(t):
    return t.epochs.filter((c("band") == "r") & c("jd").between(2460315.0, 2460325.0)).select("event_id", "jd")


@query("SELECT obj_id FROM cat_b WHERE info_flag = 0 AND (ra >= 359.45 OR ra <= 0.45) AND dec BETWEEN -25.55 AND -24.45")
def box_search(t):
    return t.cat_b.filter(spatial.in_box((359.5, 0.4), (-25.5, -24.5), 0.05) & (c("info_flag") == 0)).select("obj_id")


@query("SELECT obj_id FROM cat_b WHERE info_flag2 = 0 AND obj_info_flag = 0 AND ra BETWEEN 13.0 - 100e0 / 3600 AND 14.0 + 100e0 / 3600 AND dec BETWEEN -23.5 - 100e0 / 3600 AND -22.5 + 100e0 / 3600")
def cc_flags_filter(t):
    radius = 1.0
    b = t.cat_b.withColumn("cc_flags", F.when((c("info_flag2") == 0) & (c("obj_info_flag") == 0), "0000").otherwise("D000"))
    return b.filter((c("cc_flags") == "0000") & spatial.in_box((13.0, 14.0), (-23.5, -22.5), 100 * radius / 3600)).select("obj_id")


@query("SELECT src_id, psf_mag - mag > 0.1 AS agn_like FROM matched WHERE sqrt(psf_err * psf_err + magerr * magerr) < 0.09 AND mag IS NOT NULL")
def snr_weighted_color_cut(t):
    good = t.matched.filter((F.sqrt(c("psf_err") * c("psf_err") + c("magerr") * c("magerr")) < 0.09) & c("mag").isNotNull())
    return good.select("src_id", (c("psf_mag") - c("mag") > 0.1).alias("agn_like"))
