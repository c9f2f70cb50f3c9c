"""Named quality filters: predicates over the columns of a matched source, and their funnel.

Each is a function of keyword arguments that gives a Boolean column; a row with unknown values fails unless
the filter says otherwise. `flagged` adds them all in one projection, `funnel` counts survivors in one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.photometry import any_bit, holds, snr

c = F.col


def catalog() -> Column:
    return holds(c("catalog_flag").isin(0, 1, 2))


def psf_fit() -> Column:
    return c("psf_flag").isNull() | (c("psf_flag") == 0)


def extraction() -> Column:
    return ~any_bit(c("sep_flag"), 4, 8, 16, 32, 64, 128)


def not_extended_artifact() -> Column:
    return ~holds(any_bit(c("sep_flag"), 1) & (c("psf_mag") - c("kron_mag") > 1.5))


def shape() -> Column:
    ratio = F.try_divide(c("a"), c("b"))
    return c("a").isNull() | holds((ratio < 2) & ((ratio < 1.35) | (c("npix") < 200)))


def _snrs() -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Signal to noise in survey A and B: of the fitted and of the Kron magnitude."""
    return (snr(c("psf_mag"), c("psf_err")), snr(c("mag"), c("magerr"))), (snr(c("kron_mag"), c("kron_err")), snr(c("b_kron_mag"), c("b_kron_err")))


def snr_any(limit: float = 5.0) -> Column:
    return holds(F.greatest(*[x for pair in _snrs() for x in pair]) > limit)


def _agree(a: Column, b: Column, limit: float) -> Column:
    return holds((a > limit) & (b > limit)) | holds((a > limit) & b.isNull()) | holds((b > limit) & a.isNull())


def snr_both(limit: float = 5.0) -> Column:
    """For one kind of magnitude both surveys are above the limit, or one is and the other has none."""
    return _agree(*_snrs()[0], limit) | _agree(*_snrs()[1], limit)


def _only(side: int, limit: float) -> Column:
    return ~snr_both(limit) & (holds(_snrs()[0][side] > limit) | holds(_snrs()[1][side] > limit))


def snr_a_only(limit: float = 5.0) -> Column:
    """Above the limit in survey A alone; a row can be above it in A by one magnitude and in B by the other."""
    return _only(0, limit)


def snr_b_only(limit: float = 5.0) -> Column:
    return _only(1, limit)


def dec_above(limit: float = -29.5) -> Column:
    return holds(c("dec") > limit)


def not_saturated() -> Column:
    return ~any_bit(c("info_flag"), 128, 4096) & ~any_bit(c("info_flag2"), 4096) & (c("psf_mag").isNull() | (c("psf_mag") > 13.5))


def quality() -> Column:
    return ~(any_bit(c("quality_flag"), 1, 2, 128) | any_bit(c("obj_info_flag"), 8388608, 16777216, 1073741824))


def good_detection() -> Column:
    return ~any_bit(c("info_flag"), 2048) & ~any_bit(c("info_flag2"), 4)


def fainter_than_zero(limit: float = 22.5) -> Column:
    return holds((c("mag") > 0) & (c("mag") < limit))


FILTERS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (catalog, psf_fit, extraction, not_extended_artifact, shape, snr_any, snr_both, snr_a_only, snr_b_only, dec_above, not_saturated, quality, good_detection, fainter_than_zero)}


def flagged(df: DataFrame, names: list[str], **options: dict) -> DataFrame:
    """df with a Boolean column pass_<name> for each filter and reject_reason, the first that fails."""
    out = df.select("*", *[FILTERS[n](**options.get(n, {})).alias(f"pass_{n}") for n in names])
    reason = F.lit(None).cast("string")
    for n in reversed(names):
        reason = F.when(~F.col(f"pass_{n}"), n).otherwise(reason)
    return out.withColumn("reject_reason", reason)


COMBINED = {"gri": ("g", "r", "i"), "gr": ("g", "r"), "gi": ("g", "i"), "ri": ("r", "i")}


def band_funnel(df: DataFrame, names: list[str], key: str, by: list[str]) -> DataFrame:
    """stage, filter, bands, n_before, n_after for each group: objects that survive in a band, and in exactly a set of bands.

    df has a row for each key and band. A row is as deep as filters in turn that it passes; objects of equal depths are
    counted together, so what is spread over stages is a small table.
    """
    passed, depth = F.lit(True), F.lit(0)
    for n in names:
        passed = passed & F.col(f"pass_{n}")
        depth = depth + passed.cast("int")
    deep = flagged(df, names).select(key, *by, "band", depth.alias("_d"))
    each = deep.groupBy(key, *by).agg(*[F.coalesce(F.max(F.when(F.col("band") == b, F.col("_d"))), F.lit(-1)).alias(b) for b in "gri"])
    each = each.groupBy(*by, "g", "r", "i").agg(F.count(F.lit(1)).alias("_n"))

    def here(stage, bands):
        if bands in tuple("gri"):
            return F.col(bands) >= stage
        return sum(((F.col(b) >= stage) == F.lit(b in COMBINED[bands])).cast("int") for b in "gri") == 3

    sums = [F.sum(F.when(here(s, b), F.col("_n")).otherwise(0)).alias(f"_{s}_{b}") for s in range(len(names) + 1) for b in ("g", "r", "i", *COMBINED)]
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(n).alias("filter"), F.lit(b).alias("bands"), F.col(f"_{s - 1}_{b}").alias("n_before"), F.col(f"_{s}_{b}").alias("n_after")) for s, n in enumerate(names, 1) for b in ("g", "r", "i", *COMBINED)]
    return each.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))


def summed(funnels: DataFrame, part: str) -> DataFrame:
    """Funnels of several parts added by stage. Parts that went through different filters are an error."""
    parts = funnels.groupBy("stage").agg(F.count_distinct("filter").alias("_f"), F.count_distinct(part).alias("_p"))
    whole = parts.agg(F.max("_f").alias("_f"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    bad = whole.filter((F.col("_f") > 1) | (F.col("_lo") != F.col("_hi"))).count()
    if bad:
        raise ValueError(f"the funnels of different {part} don't have the same filters")
    return funnels.groupBy("stage", "filter").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))


def funnel(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """stage, filter, n_before, n_after for each group, from one pass over df."""
    passed, sums = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for i, n in enumerate(names, 1):
        passed = passed & F.col(f"pass_{n}")
        sums.append(F.sum(passed.cast("long")).alias(f"_{i}"))
    counts = flagged(df, names).groupBy(*by).agg(*sums)
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("filter"), F.col(f"_{i - 1}").alias("n_before"), F.col(f"_{i}").alias("n_after")) for i, n in enumerate(names, 1)])
    return counts.select(*by, F.inline(rows))
