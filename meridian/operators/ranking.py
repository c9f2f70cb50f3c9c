"""Ranks over whole tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .dedup import kept


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row by order, which should be total.

    Rows are dealt by ranges, numbered within a range and moved by what the ranges before hold. Ranges come from a
    sample, so they are kept before they are counted.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))  # a row a range
    here = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return here.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_part", "_before", "_i")
