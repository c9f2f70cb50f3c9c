"""Choosing one row of several, and greedy spatial merging as a set operation."""

from __future__ import annotations

import logging
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .spatial import ARCSEC, radius_join, unit

log = logging.getLogger(__name__)
#: Rounds after which the rows claimed so far are kept as one table.
ROUNDS = 8
#: Cells in the radius of neighbour_count: with more of them fewer places meet one by one, but more cells.
CELLS = 256


def first_valid(value: str | Column, order: str | Column) -> Column:
    """The value that isn't NULL with the least order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, F.when(value.isNotNull(), F.col(order) if isinstance(order, str) else order))


def best_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, which should be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def neighbour_count(df: DataFrame, id_col: str, radius: float, include_self: bool = True, on: tuple = ()) -> DataFrame:
    """id, n_neighbours: how many rows are within the radius.

    Places carry their number of rows, and small cells that of their places. Cells that lie wholly within reach of each
    other add whole numbers; only where the circle's edge may cut a cell do single places meet.
    """
    chord = min(2.0, 2.0 * math.sin(radius / ARCSEC / 2.0))
    side = chord / CELLS
    apart = 2.0 * math.sqrt(3.0) * side * (1 + 1e-9) + 1e-15  # what two rows of two cells may be off from the cells' first places
    u, cell, at = unit(F.col("ra"), F.col("dec")), [f"_n{i}" for i in range(3)], ["ra", "dec"]
    places = df.filter((u[0] + u[2]).isNotNull() & ~F.isnan(u[0] + u[2])).groupBy(*on, *at).agg(F.count(F.lit(1)).alias("_w"))
    places = places.select("*", *[F.floor(v / side).alias(k) for k, v in zip(cell, u)])
    cells = places.groupBy(*on, *cell).agg(F.min(F.struct(*at)).alias("_p"), F.sum("_w").alias("_all")).select(*on, *cell, "_p.*", "_all")
    other = cells.select(*on, *[F.col(k).alias(f"{k}b") for k in cell], F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.col("_all").alias("_allb"))
    reach = 2.0 * math.asin(min(1.0, (chord + apart) / 2.0)) * ARCSEC
    met = radius_join(cells, other, reach, on=on).withColumn("_inside", 2.0 * F.sin(F.col("sep") / ARCSEC / 2.0) + apart <= chord)
    whole = met.filter("_inside").groupBy(*on, *cell).agg(F.sum("_allb").alias("_whole"))
    edge = met.filter("not _inside").select(*on, *cell, *[f"{k}b" for k in cell])
    right = places.select(*on, *[F.col(k).alias(f"{k}b") for k in cell], F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.col("_w").alias("_wb"))
    d2 = sum((p - q) * (p - q) for p, q in zip(u, unit(F.col("ra2"), F.col("dec2"))))
    cut = places.drop("_w").join(edge, [*on, *cell]).join(right, [*on, *[f"{k}b" for k in cell]])
    cut = cut.filter(d2 <= chord * chord).groupBy(*on, *at).agg(F.sum("_wb").alias("_cut"))
    n = places.join(whole, [*on, *cell], "left").join(cut, [*on, *at], "left")
    n = n.select(*on, *at, (F.coalesce("_whole", F.lit(0)) + F.coalesce("_cut", F.lit(0))).alias("n"))
    n = df.select(id_col, *on, *at).join(n, [*on, *at]).groupBy(id_col).agg(F.sum("n").alias("n"))
    return n.select(id_col, (F.col("n") - (0 if include_self else 1)).alias("n_neighbours"))


def few_neighbours(df: DataFrame, id_col: str, radius: float, most: int = 5, on: tuple = ()) -> DataFrame:
    """id, alone: whether a row has at most `most` rows within the radius, itself included.

    Cells are so small that rows of one are within the radius of each other: more than `most` in a cell settle it, and so
    do no more in all cells within reach. Only the other rows, at most `most` a cell, meet their neighbours, so
    there are fewer than 125 * `most` pairs for each row, however crowded a cell is.
    """
    chord = 2.0 * math.sin(radius / ARCSEC / 2.0)
    cell = [f"_n{i}" for i in range(3)]
    x = df.select(F.col(id_col).alias("_id"), *on, "ra", "dec", *[F.floor(v / (chord / math.sqrt(3.0) * (1 - 1e-9))).alias(k) for k, v in zip(cell, unit(F.col("ra"), F.col("dec")))])
    counts = x.groupBy(*on, *cell).agg(F.count(F.lit(1)).alias("_own"))
    reach = counts
    for k in cell:
        reach = reach.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in range(-2, 3)])))
    reach = reach.groupBy(*on, *cell).agg(F.sum("_own").alias("_all"))
    x = x.join(counts.join(reach, [*on, *cell]), [*on, *cell])
    settled = x.filter((F.col("_own") > most) | (F.col("_all") <= most)).select("_id", (F.col("_own") <= most).alias("alone"))
    open_ = x.filter((F.col("_own") <= most) & (F.col("_all") > most)).select("_id", *on, "ra", "dec")
    other = df.select(*on, F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    met = radius_join(open_, other, radius, on=on).groupBy("_id").agg((F.count(F.lit(1)) <= most).alias("alone"))
    return settled.union(met).withColumnRenamed("_id", id_col)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df computed once and read again from a table in the shared folder, its lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_links(df: DataFrame, id_col: str, rank: str, radius: float, on: tuple = (), keep: tuple = ()) -> DataFrame:
    """member, owner, owner_rank and of the member the columns `keep`: greedy merging in the order (rank, id), a row for each owner that has the member within its radius.

    A row that no earlier owner has within the radius is an owner; it links itself and all later rows near it, also those
    that another owner links. Rows without neighbours or without a place own themselves.
    Rows at one place share their owners, so a place meets the others once, whatever it holds, as its first row. Owners
    are the lexicographic-first independent set of the pairs of places, found in rounds: places that wait for no earlier
    one own, what they claim is settled, and pairs with a settled place go. There are as many rounds as the longest chain
    of places that wait for each other; each keeps the pairs that are left, and nothing is gathered.
    """
    u, at = unit(F.col("ra"), F.col("dec")), [*on, "ra", "dec"]
    rows = df.select(F.col(id_col).cast("long").alias("member"), F.col(rank).alias("rank"), *at, *keep).withColumn("_at", (u[0] + u[2]).isNotNull() & ~F.isnan(u[0] + u[2]))
    places = rows.filter("_at").groupBy(*at).agg(F.min(F.struct("rank", "member")).alias("_f")).select(*at, F.col("_f.rank").alias("rank_i"), F.col("_f.member").alias("i"))
    places = kept(places)
    b = places.select(*on, F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), F.col("rank_i").alias("rank_j"), F.col("i").alias("j"))
    later = (F.col("rank_i") < F.col("rank_j")) | ((F.col("rank_i") == F.col("rank_j")) & (F.col("i") < F.col("j")))
    pairs = kept(radius_join(places, b, radius, on=on).filter(later).select("i", "rank_i", "j", "rank_j"))
    claimed, left, rounds = pairs.select("j").limit(0), pairs.select("i", "j"), 0
    while True:
        waits = left.select(F.col("j").alias("i"), F.lit(True).alias("waits")).distinct()
        step = kept(left.join(waits, "i", "left"))
        if step.isEmpty():
            break
        rounds += 1
        taken = step.filter("waits is null").select("j").distinct()
        claimed = claimed.union(taken) if rounds % ROUNDS else kept(claimed.union(taken))
        left = step.filter("waits").select("i", "j").join(taken.select(F.col("j").alias("i")), "i", "left_anti").join(taken, "j", "left_anti")
    log.info("merge_bands: %d rounds", rounds)
    # an earlier place near an owner is another's, but may hold rows that are later than the owner
    near = pairs.union(pairs.select("j", "rank_j", "i", "rank_i")).select(F.col("i").alias("owner"), F.col("rank_i").alias("owner_rank"), F.col("j").alias("i"))
    near = near.union(places.select("i", "rank_i", "i")).join(claimed.select(F.col("j").alias("owner")), "owner", "left_anti")
    near = near.join(places.select("i", *at), "i").drop("i")
    after = (F.col("owner_rank") < F.col("rank")) | ((F.col("owner_rank") == F.col("rank")) & (F.col("owner") <= F.col("member")))
    linked = rows.filter("_at").join(near, at).filter(after).select("member", "owner", "owner_rank", *keep)
    return linked.union(rows.filter("not _at").select("member", "member", "rank", *keep))


def merge_bands(df: DataFrame, id_col: str, rank: str, radius: float, on: tuple = ()) -> DataFrame:
    """member, owner: greedy merging as merge_links() says; a row near several owners is the earliest one's."""
    links = merge_links(df, id_col, rank, radius, on)
    return links.groupBy("member").agg(F.min(F.struct("owner_rank", "owner")).alias("o")).select("member", "o.owner")
