"""Structured Streaming jobs on epochs and quadrants; each gives in one run over all files what its batch form gives."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import filters, lightcurve
from ..sources.files import deleted, listed, parse_fp, there


def fp_ingest(spark: SparkSession, folder: str, columns: dict[str, str], late: str = "400 days") -> DataFrame:
    """Epochs of arriving forced-photometry files, each (position, jd, filter) once within the watermark."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = parse_fp(files, columns).withColumn("ts", F.timestamp_seconds((F.col("jd") - 2440587.5) * 86400.0))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ra", "dec", "jd", "filter"])


def window_stack(epochs: DataFrame, days: int = 10, late: str = "60 days") -> DataFrame:
    """Inverse-variance stacks in windows of `days`, a half overlapping; windows are anchored on the epoch of time."""
    w = F.window("ts", f"{days * 24} hours", f"{days * 12} hours")
    out = epochs.withWatermark("ts", late).groupBy(w.alias("w"), "source_id", "band").agg(*lightcurve.stack_columns())
    return lightcurve.detection_columns(out, "stack_flux", "stack_unc", "stack_zp").select("source_id", "band", F.col("w.start").alias("start"), "stack_flux", "stack_unc", "n", "upper_limit")


def epoch_split(epochs: DataFrame, gap: str = "30 days", late: str = "60 days") -> DataFrame:
    """Observing epochs of a source: sessions that a gap ends."""
    s = F.session_window("ts", gap)
    return epochs.withWatermark("ts", late).groupBy(s.alias("s"), "source_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("s")


class AnchoredWindows(StatefulProcessor):
    """Windows [t0, t0 + width) of one series, anchored on the first epoch not yet used, in the order of time.

    State: epochs that the watermark hasn't passed, and the open window's start and sums. An epoch is used when the
    watermark passes it, as no earlier one can arrive any more; a window is given out when the watermark passes its end.
    """

    def __init__(self, width: float, keys: list[str]):
        self.width, self.keys = width, keys

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long, jd double, flux double")
        self.window = handle.getValueState("window", "t0 double, jd double, flux double, n long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            for ms, jd, flux in zip(pdf["ms"], pdf["jd"], pdf["flux"]):
                self.pending.appendValue((int(ms), float(jd), float(flux)))
                first = ms if first is None or ms < first else first
        if first is not None:
            self.handle.registerTimer(int(first) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.pending.get())
        due = sorted((x[1:] for x in waiting if x[0] < now))
        rest = [x for x in waiting if x[0] >= now]
        window = self.window.get()
        window = list(window) if window is not None else None
        closed = []
        for jd, flux in due:
            if window is not None and not jd < window[0] + self.width:
                closed.append(window)
                window = None
            window = [jd, 0.0, 0.0, 0] if window is None else window
            window = [window[0], window[1] + jd, window[2] + flux, window[3] + 1]
        end = None if window is None else int(math.ceil((window[0] + self.width - 2440587.5) * 86400_000)) + 1
        if end is not None and end < now:
            closed.append(window)
            window, end = None, None
        if window is None:
            self.window.clear()
        else:
            self.window.update(tuple(window))
            self.handle.registerTimer(end)
        if due:
            self.pending.clear()
            if rest:
                self.pending.put(rest)
        if rest:
            self.handle.registerTimer(rest[0][0] + 1)
        if closed:
            t0, jd, flux, n = zip(*closed)
            counts = np.array(n)
            yield pd.DataFrame({**{k: [v] * len(closed) for k, v in zip(self.keys, key)}, "t0": t0, "mean_jd": np.array(jd) / counts, "mean_flux": np.array(flux) / counts, "n": counts})

    def close(self) -> None:
        pass


def anchored_windows(epochs: DataFrame, by: list[str], width: float, late: str = "60 days") -> DataFrame:
    """by, t0, mean_jd, mean_flux, n: what lightcurve.anchored_windows gives, for epochs (jd, ts, flux) that arrive in any order within `late`.

    State is kept in RocksDB, which this sets for the session, as the default store can't hold lists and timers.
    """
    spark = epochs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = epochs.filter("jd is not null and flux is not null").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late).select(*by, "jd", "flux", "ts", "ms")
    kinds = ", ".join(f"`{c}` {epochs.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).transformWithStateInPandas(AnchoredWindows(width, by), f"{kinds}, t0 double, mean_jd double, mean_flux double, n long", "append", "eventtime")


def filter_funnel(matched: DataFrame, names: list[str], by: list[str], out: str, checkpoint: str):
    """Writes the flags of each batch, and the counts of all batches so far as a table that carries its batch's number.

    A batch adds its counts to those of the last table with a smaller number, so a repeated batch makes the same table
    again. A table is there when its _SUCCESS file is; those before the last two are deleted.
    """
    spark = matched.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        filters.flagged(batch, names).write.mode("overwrite").parquet(f"{out}/flags/batch={number}")
        own = filters.funnel(batch, names, by)
        before = [n for n in _versions(spark, out) if n < number]
        total = own if not before else _added(spark.read.parquet(_version(out, before[-1])).unionByName(own), by)
        total.coalesce(1).write.mode("overwrite").parquet(_version(out, number))
        for n in before[:-1]:
            deleted(spark, _version(out, n))

    return matched.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _version(out: str, number: int) -> str:
    return f"{out}/counts/{number:012d}"


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the tables of counts that are whole, in order; there are three at most."""
    return sorted(int(name) for name in listed(spark, f"{out}/counts") if name.isdigit() and there(spark, f"{out}/counts/{name}/_SUCCESS"))


def _added(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by, "stage", "filter").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))


def running_funnel(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The counts of all batches so far: one table."""
    return spark.read.parquet(_version(out, _versions(spark, out)[-1])).select(*by, "stage", "filter", "n_before", "n_after")
