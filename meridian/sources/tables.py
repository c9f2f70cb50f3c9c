"""Catalogue-shaped tables derived by arithmetic from the given tables, the same in Spark and in plain SQL.

Each is a SELECT over the given tables and the ones above it; `tables` turns them into DataFrames, `with_clause`
into the common table expressions that a check in another engine can start with.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: In `{div}` and `{us}` the engines differ: integer division and microseconds of a time stamp.
DERIVED = {
    "pos": """SELECT o_orderkey AS k, o_orderkey % 26 AS fieldid, (o_orderkey {div} 26) % 16 + 1 AS ccdid, (o_orderkey {div} 416) % 4 + 1 AS qid,
        ((o_orderkey % 26) * 13.7e0 + ((o_orderkey * 7919) % 7200) / 3600.0e0 - 1e0 + 360e0) % 360e0 AS ra,
        -25e0 + (o_orderkey % 26) * 2e0 + ((o_orderkey * 104729) % 7200) / 3600.0e0 - 1e0 AS dec,
        14e0 + (o_totalprice % 1000e0) / 100e0 AS m FROM orders""",
    "cat_b": """SELECT k AS obj_id, fieldid, ccdid, qid, ra, dec + (k % 50 + 0.5e0) / 36000e0 AS dec,
        CASE WHEN k % 90 = 0 THEN NULL ELSE m END AS mag, k % 90 = 0 AS undetected, CASE WHEN k % 11 = 0 THEN 0.25e0 ELSE 0.03e0 END AS magerr,
        CASE WHEN k % 35 = 0 THEN NULL ELSE m - 0.1e0 END AS b_kron_mag, CASE WHEN k % 12 = 0 THEN 0.3e0 ELSE 0.05e0 END AS b_kron_err,
        CASE WHEN k % 40 = 0 THEN 128 ELSE 0 END AS info_flag, CASE WHEN k % 45 = 0 THEN 4 ELSE 0 END AS info_flag2,
        CASE WHEN k % 60 = 0 THEN 1 ELSE 4 END AS quality_flag, CASE WHEN k % 70 = 0 THEN 8388608 ELSE 0 END AS obj_info_flag,
        1 AS primary_detection FROM pos WHERE k % 10 < 8""",
    "cat_b_dup": """SELECT obj_id, fieldid, ra, dec, mag, primary_detection FROM cat_b
        UNION ALL SELECT obj_id, fieldid, ra, dec, CAST(NULL AS DOUBLE) AS mag, 0 AS primary_detection FROM cat_b WHERE obj_id % 20 = 0""",
    "cat_a": """SELECT pos.k * 10 + l_linenumber AS src_id, k, fieldid, ccdid, qid, CASE l_linenumber WHEN 1 THEN 'g' WHEN 2 THEN 'r' ELSE 'i' END AS band,
        l_linenumber AS band_rank, ra, dec + ((l_partkey % 9) - 4) / 36000e0 AS dec, m,
        m + (l_discount - 0.05e0) * 4e0 + CASE WHEN l_partkey % 50 = 0 THEN 2e0 ELSE 0e0 END AS psf_mag,
        CASE WHEN l_quantity > 45 THEN 0.3e0 ELSE 0.02e0 + l_tax END AS psf_err,
        m + (l_discount - 0.05e0) * 4e0 + CASE WHEN l_partkey % 50 = 0 THEN 2e0 ELSE 0e0 END - CASE WHEN l_suppkey % 25 = 0 THEN 2e0 ELSE 0.05e0 END AS kron_mag,
        CASE WHEN l_quantity > 40 THEN 0.25e0 ELSE 0.03e0 + l_tax END AS kron_err, CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END AS sep_flag,
        CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 4 ELSE 0 END AS psf_flag,
        1e0 + l_quantity / 40e0 AS a, 1e0 AS b, l_partkey % 400 AS npix, 22e0 AS mag_limit, (k * 31) % 3072 AS x, (k * 57) % 3080 AS y
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem WHERE l_linenumber <= 3) l
        JOIN pos ON l_orderkey = k WHERE rn = 1""",
    "matched": """SELECT cat_a.src_id, cat_a.k, cat_a.fieldid, cat_a.ccdid, cat_a.qid, cat_a.band, cat_a.band_rank, cat_a.ra, cat_a.dec, psf_mag, psf_err, kron_mag, kron_err, sep_flag, psf_flag, a, b, npix,
        mag_limit, x, y, obj_id, mag, magerr, b_kron_mag, b_kron_err, undetected, info_flag, info_flag2, quality_flag, obj_info_flag, CASE WHEN obj_id IS NULL THEN 1 ELSE 0 END AS catalog_flag
        FROM cat_a LEFT JOIN cat_b ON k = obj_id""",
    "stars": """SELECT c_custkey AS star_id, fieldid, ra, dec, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 400) - 200e0 END AS pmra,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 300) - 150e0 END AS pmdec, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 31 END AS params_solved,
        0.1e0 AS pm_err, c_acctbal / 1000e0 AS parallax_over_error, 2016e0 AS ref_epoch FROM customer JOIN pos ON c_custkey = k""",
    "epochs": """SELECT event_id, user_id AS source_id, 2460310.5e0 + ({us} - 1704067200000000) / 86400000000e0 AS jd,
        CASE WHEN event_type IN ('error', 'click') THEN 'g' WHEN event_type IN ('view', 'signup') THEN 'r' ELSE 'i' END AS band,
        value - 30e0 AS flux, 8e0 + event_id % 12 AS flux_unc, 26e0 + (event_id % 5) / 10e0 AS zp,
        CASE WHEN event_id % 17 = 0 THEN '61' WHEN event_id % 9 = 0 THEN '0,56' ELSE '0' END AS procstatus,
        CAST((event_id % 3) * 4096 + event_id % 2 AS INT) AS catflags FROM events""",
    "raw_epochs": """SELECT event_id AS seq, source_id AS source, jd - 2400000.5e0 AS mjd, ra, CASE WHEN event_id % 13 = 0 THEN dec + 0.001e0 ELSE dec + (event_id % 5) / 36000e0 END AS dec, band,
        flux, flux_unc, CASE WHEN event_id % 29 = 0 THEN CAST('NaN' AS DOUBLE) WHEN flux > 0 THEN zp - 2.5e0 * log10(flux) END AS m, 0.02e0 + (event_id % 9) / 100e0 AS e,
        source_id * 4 + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS other_id FROM epochs JOIN pos ON k = source_id""",
    "raw_ztf": "SELECT source, seq, source * 10 + seq % 3 AS oid, ra, dec, mjd, 'z' || band AS filtercode, m AS mag, e AS magerr FROM raw_epochs",
    "raw_wise": "SELECT source, seq, other_id AS source_id_mf, ra, dec, mjd, " + ", ".join(f"m + {n} AS w{n}mpro_ep, e AS w{n}sigmpro_ep, flux + {n} AS w{n}flux_ep, CASE WHEN seq % 31 = 0 THEN 0e0 ELSE flux_unc END AS w{n}sigflux_ep" for n in range(1, 5)) + " FROM raw_epochs",
    "raw_neowise": "SELECT source, seq, other_id AS source_id, ra, dec, mjd, " + ", ".join(f"m + {n} AS w{n}mpro, e AS w{n}sigmpro, flux / flux_unc AS w{n}snr" for n in (1, 2)) + " FROM raw_epochs",
    "raw_ptf": "SELECT source, seq, other_id AS oid, ra, dec, mjd AS obsmjd, seq % 3 + 1 AS fid, m AS mag_autocorr, e AS magerr_auto FROM raw_epochs",
    "raw_sdss": "SELECT source, seq, other_id AS objID, ra, dec, mjd, " + ", ".join(f"m + {i} AS psfMag_{b}, e AS psfMagerr_{b}, m + {i} - 0.1e0 AS modelMag_{b}, e * 2 AS modelMagerr_{b}" for i, b in enumerate("ugriz")) + " FROM raw_epochs",
    "raw_panstarrs": "SELECT source, seq, other_id AS objID, ra, dec, mjd AS obsTime, 0 AS infoFlag2, seq % 6 + 1 AS filterID, m AS mag, e AS magerr FROM raw_epochs",
    "raw_gaia": "SELECT source, seq, other_id AS source_id, ra, dec, 2016e0 + seq % 4 AS ref_epoch, flux AS phot_g_mean_flux, flux_unc AS phot_g_mean_flux_error, flux + 9 AS phot_rp_mean_flux, flux_unc AS phot_rp_mean_flux_error, flux - 9 AS phot_bp_mean_flux, flux_unc AS phot_bp_mean_flux_error FROM raw_epochs",
    "raw_custom": "SELECT source, seq, 'custom_' || CAST(source AS VARCHAR(20)) AS custom_id, mjd, m AS custom_mag, e AS custom_magerr, band AS filter, 0 AS ul FROM raw_epochs",
    "masked": "SELECT fieldid, ccdid, qid, (k * 31) % 3072 + k % 25 - 12 AS mx, (k * 57) % 3080 + k % 7 AS my FROM pos WHERE k % 12 = 0",
    "truth": """SELECT s_suppkey AS inj_id, 16 + s_suppkey % 9 AS mag, s_suppkey % 10 AS iter, ((s_suppkey * 10) * 31) % 3072 + (s_suppkey % 3) * 0.6e0 AS tx,
        CAST(((s_suppkey * 10) * 57) % 3080 AS DOUBLE) AS ty, fieldid, ccdid, qid FROM supplier JOIN pos ON k = s_suppkey * 10""",
}


SPECTRUM = "spectrum AS (SELECT vec_id, CAST(7400 + (i - 1) * 8 AS DOUBLE) AS wavelength, CAST(embedding[i] AS DOUBLE) AS flux FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def with_clause(*, div: str = "//", us: str = "epoch_us(ts)") -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql.format(div=div, us=us)})" for name, sql in DERIVED.items()) + ",\n" + SPECTRUM + "\n"


class Tables:
    """The given tables and the derived ones as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            sql = DERIVED.get(name)
            if sql is None:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = sql.format(div="div", us="unix_micros(cast(ts as timestamp))")
                used = {t: getattr(self, t) for t in dict.fromkeys(re.findall(r"(?:FROM|JOIN) (\w+)", sql))}
                sql = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2} AS \2", sql)
                self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]

    @cached_property
    def spectrum(self) -> DataFrame:
        from pyspark.sql import functions as F

        vec = self.embeddings
        array = next(f.name for f in vec.schema if f.dataType.typeName() == "array")
        key = next(f.name for f in vec.schema if f.dataType.typeName() in ("long", "integer"))
        return vec.select(F.col(key).alias("vec_id"), F.posexplode(array).alias("pos", "v")).select("vec_id", (7400 + F.col("pos") * 8).cast("double").alias("wavelength"), F.col("v").cast("double").alias("flux"))
