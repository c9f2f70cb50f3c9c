"""Light curves: stacking, collapsing and splitting of epochs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StructField, StructType


def stack_columns(snr_limit: float = 3.0) -> list[Column]:
    """Inverse-variance stack of flux, flux_unc, zp within a group: flux, its error, zero point, magnitude or limit, n."""
    w = 1.0 / (F.col("flux_unc") * F.col("flux_unc"))
    sw = F.sum(w)
    return [(F.sum(F.col("flux") * w) / sw).alias("stack_flux"), (1.0 / F.sqrt(sw)).alias("stack_unc"), (F.sum(F.col("zp") * w) / sw).alias("stack_zp"), (F.sum(F.col("jd") * w) / sw).alias("stack_jd"), F.count(F.lit(1)).alias("n")]


def detection_columns(df: DataFrame, flux: str, unc: str, zp: str, snr_limit: float = 3.0) -> DataFrame:
    f, s, z = F.col(flux), F.col(unc), F.col(zp)
    upper = (f <= 0) | (f / s < snr_limit)
    return df.withColumn("upper_limit", upper).withColumn("out_mag", F.when(upper, z - 2.5 * F.log10(5.0 * s)).otherwise(z - 2.5 * F.log10(F.when(f > 0, f))))


def stack(df: DataFrame, by: list[str]) -> DataFrame:
    return detection_columns(df.groupBy(*by).agg(*stack_columns()), "stack_flux", "stack_unc", "stack_zp")


def rolling_stack_days(df: DataFrame, by: list[str], width: float, step: float | None = None) -> DataFrame:
    """Stacks in windows [centre - width/2, centre + width/2) whose centres start at each series' first epoch + width/2."""
    step = width / 2 if step is None else step
    span = df.groupBy(*by).agg(F.min("jd").alias("_lo"), F.max("jd").alias("_hi"))
    d = df.join(span, by)
    count = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") - width + step) / step), F.lit(0))
    # window k covers [lo + k step, lo + k step + width)
    t = F.col("jd") - F.col("_lo")
    first = F.greatest(F.floor((t - width) / step) + 1, F.lit(0))
    last = F.least(F.floor(t / step), count - 1)
    d = d.filter(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    d = d.filter((F.col("jd") >= F.col("_lo") + F.col("k") * step) & (F.col("jd") < F.col("_lo") + F.col("k") * step + width))
    return stack(d, [*by, "k"])


def rolling_stack_rows(df: DataFrame, by: list[str], width: int, step: int) -> DataFrame:
    """Stacks of the rows i - h to i + h, h = width // 2, for i from h by max(1, step) while i < n - h."""
    h, step = width // 2, max(1, step)
    w = Window.partitionBy(*by).orderBy("jd", "event_id")
    frame = w.rowsBetween(-h, h)
    d = df.withColumn("i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    weight = 1.0 / (F.col("flux_unc") * F.col("flux_unc"))
    sw = F.sum(weight).over(frame)
    d = d.withColumn("stack_flux", F.sum(F.col("flux") * weight).over(frame) / sw).withColumn("stack_unc", 1.0 / F.sqrt(sw))
    return d.filter((F.col("i") >= h) & (F.col("i") < F.col("_n") - h) & ((F.col("i") - h) % step == 0)).select(*by, "i", "stack_flux", "stack_unc")


def epoch_split(df: DataFrame, by: list[str], gap: float) -> DataFrame:
    """df with epoch_no, which grows by one after a gap longer than `gap`."""
    w = Window.partitionBy(*by).orderBy("jd", "event_id")
    new = F.coalesce((F.col("jd") - F.lag("jd").over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("epoch_no", F.sum("_new").over(w)).drop("_new")


def anchored(df: DataFrame, by: list[str], width: float, closed: bool = False) -> DataFrame:
    """df with t0, the start of its window [t0, t0 + width), or [t0, t0 + width] if closed; windows start at the first epoch not yet used.

    Sorted series stream through a task, which remembers the series and the window that it is in and finds the end of a
    window by search; a series is never held as a whole. Epochs without a time have no window.
    """
    side = "right" if closed else "left"

    def run(batches):
        last, t0 = None, None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            jd = batch.column("jd").to_numpy(zero_copy_only=False).astype(float)
            codes = [batch.column(c).dictionary_encode() for c in by]
            codes = np.stack([x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in codes]) if by else np.zeros((1, n))
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist(), n]
            out = np.full(n, np.nan)
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(batch.column(c)[lo].as_py() for c in by)
                if key != last:
                    last, t0 = key, None
                lo += int(np.isnan(jd[lo:hi]).sum())  # nulls come first
                while lo < hi:
                    if t0 is None or not (jd[lo] <= t0 + width if closed else jd[lo] < t0 + width):
                        t0 = jd[lo]
                    end = max(lo + 1, lo + int(np.searchsorted(jd[lo:hi], t0 + width, side)))
                    out[lo:end], lo = t0, end
            yield batch.append_column("t0", pa.array(out, from_pandas=True))

    dealt = df.withColumn("jd", F.nanvl(F.col("jd").cast("double"), F.lit(None))).repartition(*by).sortWithinPartitions(*by, "jd")
    return dealt.mapInArrow(run, StructType([*dealt.schema, StructField("t0", DoubleType())]))


def anchored_windows(df: DataFrame, by: list[str], width: float) -> DataFrame:
    """Mean time and flux of windows [t0, t0 + width) anchored on the first epoch not yet used."""
    return anchored(df, by, width).groupBy(*by, "t0").agg(F.avg("jd").alias("mean_jd"), F.avg("flux").alias("mean_flux"), F.count(F.lit(1)).alias("n"))


def same_night(df: DataFrame, by: list[str], days: float = 1.0, first: list[str] | None = None) -> DataFrame:
    """Rows up to `days` after the first row of a window, but at another time, are merged with it; ties with it stand alone.

    The columns of `first` are those of the first row of what is merged.
    """
    tied = F.row_number().over(Window.partitionBy(*by, "t0", "jd").orderBy("event_id"))
    d = anchored(df, by, days, closed=True).withColumn("_tie", F.when(F.col("jd") == F.col("t0"), tied).otherwise(1))
    n = F.count(F.lit(1))
    own = [F.min_by(F.struct(*first), F.struct("jd", "event_id")).alias("_f")] if first else []
    out = d.groupBy(*by, "t0", "_tie").agg(F.avg("jd").alias("jd"), F.avg("flux").alias("flux"), (F.sqrt(F.sum(F.col("flux_unc") * F.col("flux_unc"))) / n).alias("flux_unc"), n.alias("n"), *own).drop("t0", "_tie")
    return out.select("*", "_f.*").drop("_f") if first else out
