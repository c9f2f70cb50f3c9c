"""Queries on the light curves of eight surveys: common columns, one object a source, one series of all."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.photometry import flux_to_mag, flux_to_mag_err
from ..operators import dedup, surveys
from ..sources import quadrants
from .curves import r6
from .groups import _RANGE, ranges
from .joins import _SEP
from .registry import query

c = F.col


def _raw(t) -> dict[str, DataFrame]:
    return {name: getattr(t, f"raw_{name}") for name in surveys.SURVEYS}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c(n)).alias(n) if kind == "double" else c(n) for n, kind in df.dtypes])


_OK = "CASE WHEN isfinite({0}) AND {0} <> -999 THEN {0} END"


def _own(head: str, columns: dict[str, str], table: str) -> str:
    return f"SELECT source, '{table}' AS survey, seq, {head}, " + ", ".join(f"{_OK.format(f'({x})')} AS {n}" for n, x in columns.items()) + f" FROM raw_{table}"


def _by_filter(column: str, mag: str, err: str, names: dict) -> dict[str, str]:
    return {f"{b}_{k}": f"CASE WHEN {column} = {i} THEN {x} END" for i, b in names.items() for k, x in (("mag", mag), ("magerr", err))}


def _flux(b: str, zp: float) -> dict[str, str]:
    f = f"phot_{b}_mean_flux"
    return {f"gaia_{b}_mag": f"CASE WHEN {f} > 0 THEN {zp} - 2.5 * log10({f}) END", f"gaia_{b}_magerr": f"CASE WHEN {f} > 0 THEN 2.5 * {f}_error / (ln(10) * {f}) END"}


#: The common columns of each survey, written out for the checks.
_COMMON = {
    "ztf": _own("oid AS ztf_id, ra, dec, mjd", _by_filter("filtercode", "mag", "magerr", {"'zg'": "g", "'zr'": "r", "'zi'": "i"}), "ztf"),
    "wise": _own("source_id_mf AS wise_id, ra, dec, mjd", {k: v for n in "1234" for k, v in ((f"w{n}_mag", f"w{n}mpro_ep"), (f"w{n}_magerr", f"w{n}sigmpro_ep"), (f"w{n}_snr", f"w{n}flux_ep / nullif(w{n}sigflux_ep, 0)"))}, "wise"),
    "neowise": _own("source_id AS neowise_id, ra, dec, mjd", {k: v for n in "12" for k, v in ((f"w{n}_mag", f"w{n}mpro"), (f"w{n}_magerr", f"w{n}sigmpro"), (f"w{n}_snr", f"w{n}snr"))}, "neowise"),
    "ptf": _own("oid AS ptf_id, ra, dec, obsmjd AS mjd", _by_filter("fid", "mag_autocorr", "magerr_auto", {1: "ptf_G", 2: "ptf_R"}), "ptf"),
    "sdss": _own("objID AS sdss_id, ra, dec, mjd", {k: v for b in "ugriz" for k, v in ((f"{b}Psf_mag", f"psfMag_{b}"), (f"{b}Psf_magerr", f"psfMagerr_{b}"), (f"{b}Model_mag", f"modelMag_{b}"), (f"{b}Model_magerr", f"modelMagerr_{b}"))}, "sdss"),
    "panstarrs": _own("objID AS panstarrs_id, ra, dec, obsTime AS mjd", _by_filter("filterID", "mag", "magerr", {i + 1: f"pstarr_{b}" for i, b in enumerate("grizy")}), "panstarrs"),
    "gaia": _own("source_id AS gaia_id, ra, dec, 51544.5e0 + (ref_epoch - 2000) * 365.25e0 AS mjd", _flux("g", 25.8010) | _flux("rp", 25.1040) | _flux("bp", 25.3540), "gaia"),
    "custom": _own("custom_id, CAST(NULL AS DOUBLE) AS ra, CAST(NULL AS DOUBLE) AS dec, mjd", _by_filter("filter", "custom_mag", "custom_magerr", {f"'{b}'": f"custom_{b}" for b in "griz"}), "custom"),
}
_ROUND = "round(COLUMNS(* EXCLUDE ({})), 6)"
_COMMONS = ", ".join(f"c_{n} AS ({sql})" for n, sql in _COMMON.items())
_IDS = [f"{n}_id" for n in _COMMON]


@query(f"WITH {_COMMONS}, u AS ({' UNION ALL BY NAME '.join(f'SELECT * FROM c_{n}' for n in _COMMON)}) SELECT source, survey, seq, {', '.join(_IDS)}, round(COLUMNS(* EXCLUDE (source, survey, seq, {', '.join(_IDS)})), 6) FROM u")
def survey_spec(t):
    """The tables of eight surveys in common columns."""
    parts = [surveys.compiled(df, surveys.SURVEYS[name]) for name, df in _raw(t).items()]
    return _rounded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


_NEAR = """near AS (SELECT * EXCLUDE (mra, mdec) FROM (SELECT *, (degrees(atan2(avg(sin(radians(ra))) OVER w, avg(cos(radians(ra))) OVER w)) + 360) % 360 AS mra, avg(dec) OVER w AS mdec FROM c_ztf WINDOW w AS (PARTITION BY source))
WHERE 2 * asin(least(1, sqrt(pow(cos(radians(dec)) * cos(radians(ra)) - cos(radians(mdec)) * cos(radians(mra)), 2) + pow(cos(radians(dec)) * sin(radians(ra)) - cos(radians(mdec)) * sin(radians(mra)), 2) + pow(sin(radians(dec)) - sin(radians(mdec)), 2)) / 2)) * 648000 / pi() < 1.5)"""
_FIRST = ", ".join(f"o_{n} AS (SELECT * FROM c_{n} QUALIFY {n}_id = first_value({n}_id) OVER (PARTITION BY source ORDER BY seq))" for n in _COMMON if n != "ztf")


@query(f"WITH {_COMMONS}, {_NEAR}, {_FIRST} SELECT source, survey, seq FROM near " + " ".join(f"UNION ALL SELECT source, survey, seq FROM o_{n}" for n in _COMMON if n != "ztf"))
def same_object_only(t):
    """Rows near the mean position, in the survey whose bands have ids of their own; in the others those of the first row's id."""
    parts = [surveys.same_object(surveys.compiled(df, surveys.SURVEYS[name]), surveys.SURVEYS[name]).select("source", "survey", "seq") for name, df in _raw(t).items()]
    return reduce(DataFrame.union, parts)


_WISE = [f"w{n}_{x}" for n in "1234" for x in ("mag", "magerr", "snr")]
_SERIES = f"""wo AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mjd, seq) AS n FROM o_wise),
ww AS (SELECT source, n, mjd, mjd AS t0 FROM wo WHERE n = 1 UNION ALL SELECT wo.source, wo.n, wo.mjd, CASE WHEN wo.mjd < ww.t0 + 3 THEN ww.t0 ELSE wo.mjd END FROM ww JOIN wo ON wo.source = ww.source AND wo.n = ww.n + 1),
s_wise AS (SELECT wo.source, any_value(survey) AS survey, min(wise_id) AS wise_id, avg(ra) AS ra, avg(dec) AS dec, avg(wo.mjd) AS mjd, {', '.join(f'avg({x}) AS {x}' for x in _WISE)} FROM ww JOIN wo USING (source, n) GROUP BY wo.source, t0),
pb AS (SELECT * FROM (SELECT source, survey, seq, panstarrs_id, ra, dec, mjd, unnest(['g', 'r', 'i', 'z', 'y']) AS band, unnest([pstarr_g_mag, pstarr_r_mag, pstarr_i_mag, pstarr_z_mag, pstarr_y_mag]) AS m, unnest([pstarr_g_magerr, pstarr_r_magerr, pstarr_i_magerr, pstarr_z_magerr, pstarr_y_magerr]) AS e FROM o_panstarrs) WHERE m IS NOT NULL),
po AS (SELECT *, row_number() OVER (PARTITION BY source, band ORDER BY mjd, seq) AS n FROM pb),
pw AS (SELECT source, band, n, mjd, mjd AS t0, 0 AS tie FROM po WHERE n = 1 UNION ALL SELECT po.source, po.band, po.n, po.mjd, CASE WHEN po.mjd <= pw.t0 + 1 THEN pw.t0 ELSE po.mjd END, CASE WHEN po.mjd = pw.t0 THEN po.n ELSE 0 END FROM pw JOIN po ON po.source = pw.source AND po.band = pw.band AND po.n = pw.n + 1),
pn AS (SELECT po.source, po.band, min_by(struct_pack(id := panstarrs_id, ra := ra, dec := dec), po.n) AS f, avg(po.mjd) AS mjd, avg(m) AS m, sqrt(sum(e * e)) / count(*) AS e FROM pw JOIN po USING (source, band, n) GROUP BY po.source, po.band, t0, tie),
s_panstarrs AS (SELECT source, 'panstarrs' AS survey, f.id AS panstarrs_id, f.ra AS ra, f.dec AS dec, mjd, {', '.join(f"CASE WHEN band = '{b}' THEN m END AS pstarr_{b}_mag, CASE WHEN band = '{b}' THEN e END AS pstarr_{b}_magerr" for b in 'grizy')} FROM pn)"""


@query(f"WITH RECURSIVE {_COMMONS}, {_NEAR}, {_FIRST}, {_SERIES}, u AS (SELECT * EXCLUDE (seq) FROM near " + " ".join(f"UNION ALL BY NAME SELECT * FROM s_{n}" if n in ("wise", "panstarrs") else f"UNION ALL BY NAME SELECT * EXCLUDE (seq) FROM o_{n}" for n in _COMMON if n != "ztf") + f") SELECT source, survey, {', '.join(_IDS)}, round(COLUMNS(* EXCLUDE (source, survey, {', '.join(_IDS)})), 6) FROM u")
def assemble_lc(t):
    """Light curves of all sources: one object each, nights and windows collapsed, eight surveys in tidy columns."""
    return _rounded(surveys.assembled(_raw(t)))


_OBJ = "ob AS (SELECT src_id, k, fieldid, band, ccdid % 2 + 1 AS ccdid, qid % 2 + 1 AS qid, 13 + fieldid % 2 AS release, ra, dec FROM cat_a)"
_GOOD = """good AS (SELECT source_id, band, event_id, jd - 2400000.5e0 AS hmjd, zp - 2.5 * log10(flux) AS mag, 2.5 * flux_unc / (ln(10) * flux) AS magerr FROM epochs WHERE flux > 0 AND (catflags & 6141) = 0)"""


def _quadrants(t) -> DataFrame:
    """The catalogue of files of array light curves, one a quadrant and band, which are written first."""
    folder = f"{dedup.shared_folder(t.spark)}/quadrants-{uuid.uuid4().hex}"
    mag, err = flux_to_mag(c("flux"), c("zp")), flux_to_mag_err(c("flux"), c("flux_unc"))
    epoch = F.struct((c("jd") - 2400000.5).alias("hmjd"), mag.alias("mag"), err.alias("magerr"), "catflags")
    series = t.epochs.groupBy(c("source_id").alias("k"), "band").agg(F.array_sort(F.collect_list(epoch)).alias("e"))
    rows = t.cat_a.select("src_id", "k", "fieldid", "band", (c("ccdid") % 2 + 1).alias("ccdid"), (c("qid") % 2 + 1).alias("qid"), (13 + c("fieldid") % 2).alias("release"), "ra", "dec").join(series, ["k", "band"], "left")
    arrays = [c(f"e.{x}").alias(x) for x in ("hmjd", "mag", "magerr", "catflags")]
    quadrants.write(rows.select(*quadrants.KEYS, c("src_id").alias("objectid"), c("ra").alias("objra"), c("dec").alias("objdec"), *arrays), folder)
    return quadrants.catalogue(t.spark, folder)


@query(f"WITH {_OBJ} SELECT fieldid, band, ccdid, qid, release, count(*) AS n FROM ob GROUP BY ALL")
def file_catalog(t):
    """Files found by listing a folder, what their names say, and how many objects each holds."""
    files = _quadrants(t)
    n = quadrants.opened(t.spark, files, ["objectid"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(n, "path").select(*quadrants.KEYS, "n")


@query(f"WITH {_OBJ} SELECT fieldid, ccdid, qid, count(DISTINCT band) AS bands, min(release) AS release FROM ob GROUP BY ALL")
def quadrant_meta(t):
    """Quadrants with files, out of the files' names alone."""
    return _quadrants(t).groupBy("fieldid", "ccdid", "qid").agg(F.count_distinct("band").alias("bands"), F.min("release").alias("release"))


@query(f"WITH {_OBJ} SELECT fieldid, ccdid, qid, src_id, band FROM ob")
def merge_field(t):
    """The files of all quadrants stacked, with field, detector and quadrant from the path of the file that a row comes from."""
    rows = quadrants.opened(t.spark, _quadrants(t), ["objectid"])
    return rows.select("fieldid", "ccdid", "qid", c("objectid").alias("src_id"), "band")


_PLACED = f"""WITH {_OBJ}, {_GOOD}, fr AS ({_RANGE.format('cat_a')}), p AS (SELECT star_id, ra, dec, fr.fieldid FROM stars JOIN fr ON dec BETWEEN dec_lo AND dec_hi AND (ra BETWEEN ra_lo AND ra_hi OR ra + 360 BETWEEN ra_lo AND ra_hi)),
n AS (SELECT a.star_id, b.src_id, b.band, b.k FROM p a JOIN ob b ON a.fieldid = b.fieldid AND abs(a.dec - b.dec) < 0.001 WHERE {_SEP} < 1.5 QUALIFY row_number() OVER (PARTITION BY a.star_id, b.fieldid, b.band, b.ccdid, b.qid ORDER BY {_SEP}, b.src_id) = 1)"""


@query(f"{_PLACED} SELECT star_id, src_id AS objectid, n.band, round(hmjd, 6) AS hmjd, round(mag, 6) AS mag, round(magerr, 6) AS magerr FROM n JOIN good ON source_id = k AND good.band = n.band")
def lc_by_position(t):
    """Footprints give the files of a position; the nearest object of each file within 1.5 arc seconds, its clean epochs."""
    found = quadrants.at_positions(t.spark, _quadrants(t), t.stars.select("star_id", "ra", "dec"), ranges(t.cat_a), 1.5, "star_id")
    return quadrants.light_curves(t.spark, dedup.kept(found), "star_id").select("star_id", "objectid", "band", *[r6(c(x)).alias(x) for x in ("hmjd", "mag", "magerr")])


@query(f"WITH {_OBJ}, {_GOOD} SELECT star_id, src_id AS objectid, ob.band, round(hmjd, 6) AS hmjd, round(mag, 6) AS mag, round(magerr, 6) AS magerr FROM stars JOIN ob ON src_id = star_id * 10 + 2 JOIN good ON source_id = k AND good.band = ob.band")
def lc_by_object(t):
    """Light curves by object id, in whichever file it is."""
    ids = t.stars.select("star_id", (c("star_id") * 10 + 2).alias("objectid"))
    found = quadrants.of_objects(t.spark, _quadrants(t), ids, "star_id")
    return quadrants.light_curves(t.spark, dedup.kept(found), "star_id").select("star_id", "objectid", "band", *[r6(c(x)).alias(x) for x in ("hmjd", "mag", "magerr")])
