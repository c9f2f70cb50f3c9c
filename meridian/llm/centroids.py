"""Centroid clustering in exact integers: a vantage-point tree over the centroids, rebuilt and broadcast each round.

A vector's nearest centroid is found by best-first branch and bound: its nodes are opened in the order of the least
distance that they can hold, until that is more than the best distance found (at equality a node is still opened, as it
may hold the same distance under a smaller number). Distances are sums of squares of integers, so neither the order of
rows nor a repeated task changes a result. A task adds up its vectors by centroid; k rows for each component are shuffled.

Kept are vectors of `size` components, none of them null, NaN or infinite, and none of 2^64 or more when multiplied by
SCALE (sums of those need more than 38 digits). A distance or inertia beyond a long is null. Rows without an id are never
chosen to start with; rows under one id are told apart by their components, equal rows each count. With fewer than k rows
to start from there are fewer centroids, with none no result. Columns other than the id and the vector are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, LIMIT = 64, 2.0**64
#: Components below this have distances that fit 64 bits for up to 512 of them; others are computed as Python's integers.
SMALL = 1 << 26
#: Centroids in a leaf, and entries (vectors times nodes) of one search.
LEAF, ENTRIES = 4, 1 << 20
LONG = (1 << 63) - 1
#: Distances as doubles are off by less than this share.
SLACK = 1e-9


def kept(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """The rows that are clustered, with their vector as an array of doubles, _v."""
    whole = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / SCALE))
    return vectors.withColumn("_v", F.col(f"`{vector}`").cast("array<double>")).filter((F.size("_v") == size) & whole)


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where distances fit them, else Python's."""
    q = np.floor(SCALE * x)  # exact, as SCALE is a power of two
    if not q.size or np.abs(q).max() < SMALL:
        return q.astype(np.int64)
    return np.array([[int(c) for c in row] for row in q.tolist()], object)


class Tree:
    """A vantage-point tree. Each node has the numbers of its own centroids and, if it is an inner one, two children
    with the least and largest distance of theirs from its vantage point."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(c) < SMALL for row in centroids for c in row)
        self.points = np.array(centroids, np.int64 if small else object)
        self.own: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if centroids:
            self._add(list(range(len(centroids))))

    def _add(self, numbers: list[int]) -> int:
        node = len(self.own)
        self.own.append(numbers if len(numbers) <= LEAF else numbers[:1])
        self.children.append([])
        if len(numbers) > LEAF:
            away = np.sqrt(squares(self.points[numbers[1:]], self.points[numbers[0]]).astype(float))
            order = np.argsort(away, kind="stable")
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                child = self._add([numbers[1 + i] for i in half])
                self.children[node].append((child, float(away[half[0]]), float(away[half[-1]])))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector; of several the smallest number."""
        exact = object if object in (vectors.dtype, self.points.dtype) else np.int64
        vectors, points = vectors.astype(exact), self.points.astype(exact)
        number, least = np.full(len(vectors), len(points), np.int64), np.zeros(len(vectors), exact)
        step = max(1, ENTRIES // len(self.own))
        for lo in range(0, len(vectors), step):
            part = slice(lo, lo + step)
            self._search(vectors[part], points, number[part], least[part])
        return number, least

    def _search(self, vectors: np.ndarray, points: np.ndarray, number: np.ndarray, least: np.ndarray) -> None:
        bound = np.full((len(vectors), len(self.own)), np.inf)  # of nodes that are known and not opened yet
        bound[:, 0] = 0
        radius, open_ = np.full(len(vectors), np.inf), np.arange(len(vectors))
        while len(open_):
            node = bound[open_].argmin(1)
            low = bound[open_, node]
            go = (low <= radius[open_]) & (low < np.inf)
            open_, node = open_[go], node[go]
            bound[open_, node] = np.inf
            for n in np.unique(node):
                rows = open_[node == n]
                for c in self.own[n]:
                    d = squares(vectors[rows], points[c])
                    better = (number[rows] == len(points)) | (d < least[rows]) | ((d == least[rows]) & (c < number[rows]))
                    number[rows[better]], least[rows[better]] = c, d[better]
                radius[rows] = np.sqrt(least[rows].astype(float)) * (1 + SLACK)
                if self.children[n]:
                    away = np.sqrt(d.astype(float))  # an inner node's only centroid is its vantage point
                    for child, near, far in self.children[n]:
                        bound[rows, child] = np.maximum(np.maximum(near - away, away - far) - SLACK * (away + far), 0)


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return (d * d).sum(1)


def _vectors(batches, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, integers(batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size))


def first_centroids(rows: DataFrame, key: Column, k: int) -> list[list[int]]:
    """The integers of the k rows with the smallest key, in its order; of equal ones the smaller components."""
    found = rows.select(key.alias("_key"), "_v").filter("_key is not null").orderBy("_key", "_v").limit(k).collect()
    return [[int(c) for c in q] for r in found for q in integers(np.array([r["_v"]], float))]


def moved(rows: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after one round: floors of the means of what is nearest to each; empty ones stay."""
    tree = rows.sparkSession.sparkContext.broadcast(Tree(centroids))  # k centroids, a parameter

    def sums(batches):
        total, count = {}, {}
        for _, q in _vectors(batches, size):
            number, _d = tree.value.nearest(q)
            for c in np.unique(number).tolist():
                mine = q[number == c]
                total[c] = total.get(c, 0) + mine.sum(0).astype(object)
                count[c] = count.get(c, 0) + len(mine)
        for c in total:
            column = pa.array([Decimal(x) for x in total[c]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([c] * size, pa.int32()), pa.array(range(size), pa.int32()), column, pa.array([count[c]] * size, pa.int64())], ["cluster", "pos", "total", "n"])

    parts = rows.select("_v").mapInArrow(sums, "cluster int, pos int, total decimal(38,0), n long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k rows a component
        out[r["cluster"]][r["pos"]] = int(r["total"]) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]], size: int, id_column: str) -> DataFrame:
    """id, cluster, distance (squared) of each row."""
    tree = rows.sparkSession.sparkContext.broadcast(Tree(centroids))
    keys = rows.select(F.col(f"`{id_column}`").alias("_id"), "_v")

    def run(batches):
        for batch, q in _vectors(batches, size):
            number, d = tree.value.nearest(q)
            fits = [x if x <= LONG else None for x in d.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(number, pa.int32()), pa.array(fits, pa.int64())], ["_id", "cluster", "distance"])

    return keys.mapInArrow(run, f"_id {keys.schema['_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, key: Column, id_column: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row, after so many rounds from the k rows of smallest key."""
    rows = kept(vectors, vector, size)
    centroids = first_centroids(rows, key, k)
    if centroids:
        for _ in range(rounds):
            centroids = moved(rows, centroids, size)
    spark = vectors.sparkSession
    found = written(assigned(rows if centroids else rows.limit(0), centroids, size, id_column), "clusters")
    whole = F.count("distance") == F.count(F.lit(1))
    sums = found.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # k rows
    fits = lambda s: None if s is None or s > LONG else int(s)
    total = None if any(r["s"] is None for r in sums) else fits(sum(r["s"] for r in sums))
    about = [(r["cluster"], fits(r["s"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("_id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
