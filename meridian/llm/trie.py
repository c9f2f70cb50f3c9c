"""The prefix trie of conversations, by range partitions whose splitter paths are its skeleton.

A conversation is a path of turns, each 16 bytes of the SHA-256 of its role and text, so that the conversations under a node
stand together in the order of paths. Splitters cut that order into shards. Whatever crosses a cut is a prefix of the
splitter there, so the trie of the splitter paths, which is broadcast, holds every node that more than one shard shares: each shard
finishes all its other nodes from one pass over its sorted rows, and gives partial aggregates of the skeleton's nodes, which
are added up by node. Equal paths are ordered by id, so a cut can go through a group of equal conversations as well.

Turns are ordered by turn (null first), turns under one number by the hash of role and text; a null role or text is an
empty one. A turn without a conversation is left out. A conversation is one row, of 16 bytes a turn. An empty table has no
node, not even a root. Columns other than conv_id, turn, role and text are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of a turn in a path.
WIDTH = 16
#: Turns of a shard about; sampled conversations for each splitter; bytes that all splitter paths take at most.
SHARD_TURNS, SAMPLED, SKELETON_BYTES = 400_000, 20, 32 << 20
#: Ids in one row of what shards send of a skeleton node's own members.
IDS = 20_000
ROWS = 20_000

_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
#: kind: node (finished; skel: the skeleton node that is its parent, or null), part (of skeleton node skel), ends (ids of its own members).
LOCAL = "kind string, skel long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, text string, shard int, seq long"
_NAMES = [f.split()[0] for f in LOCAL.split(", ")]
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in LOCAL.split(", ")])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (hash, chars) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    t = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.unhex(said).alias("hash"), F.char_length(text).cast("int").alias("chars"))
    order = F.array_sort(F.collect_list(F.struct("turn", "hash", "chars")))
    return t.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(order, lambda x: F.struct(x["hash"].alias("hash"), x["chars"].alias("chars"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, chars (of each turn) of whole conversations."""
    return _packed(turns_of(conversations))


def rebuilt(conversations: DataFrame, base: Column, h: Column, most: int) -> DataFrame:
    """Like paths(), each conversation's first h (at most `most`) turns replaced by those of conversation `base`, expressions of conv_id."""
    own = written(turns_of(conversations), "turns")
    heads = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    both = own.withColumns({"_base": base, "_h": h.cast("int")}).join(heads, "_base", "left")
    empty = F.array().cast(own.schema["turns"].dataType)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), empty)
    return _packed(both.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns")))


def _packed(turns: DataFrame) -> DataFrame:
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), ""))  # linear in the turns
    return turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Up to shards - 1 places (path, id) that cut the order of rows into like parts.

    Paths are cut short, so that all of them take SKELETON_BYTES at most: an order of (path, id) is cut as well by a
    prefix of a path, and nodes deeper than that never cross it.
    """
    deep = max(1, SKELETON_BYTES // (WIDTH * shards)) * WIDTH
    sample = rows.select(F.substring("path", 1, deep).alias("path"), "conv_id", F.xxhash64("conv_id").alias("_o")).orderBy("_o", "conv_id").limit(SAMPLED * shards)
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in sample.select("path", "conv_id").collect())
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


class Skeleton:
    """The trie of splitter paths: children by hash; node 0 is the root."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path, _ in cuts:
            at = 0
            for i in range(0, len(path), WIDTH):
                step = path[i : i + WIDTH]
                if step not in self.children[at]:
                    self.children[at][step] = len(self.children)
                    self.children.append({})
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.children[at][step]


class Node:
    __slots__ = ("skel", "least", "convs", "children", "leaves", "saved", "chars", "sha", "ids", "parent", "depth", "sent")

    def __init__(self, parent: Node | None, skel: int | None, chars: int):
        self.parent, self.skel, self.chars = parent, skel, chars
        self.depth = parent.depth + 1 if parent else 0
        self.least, self.convs, self.children, self.leaves, self.saved, self.sent = None, 0, 0, 0, 0, 0
        self.sha, self.ids = None, []


class Shard:
    """One pass over the rows of a shard in the order of (path, id); out gets rows of LOCAL."""

    def __init__(self, skeleton: Skeleton, number: int):
        self.skeleton, self.number, self.out = skeleton, number, []
        self.stack, self.path, self.done = [Node(None, 0, 0)], b"", []

    def add(self, conv_id: int, path: bytes, chars: list[int]) -> None:
        stack, depth = self.stack, 0
        if path != self.path:
            most = min(len(path), len(self.path)) // WIDTH
            while depth < most and path[depth * WIDTH : (depth + 1) * WIDTH] == self.path[depth * WIDTH : (depth + 1) * WIDTH]:
                depth += 1
            while len(stack) > depth + 1:
                self._close()
            for d in range(depth, len(path) // WIDTH):
                top = stack[-1]
                skel = None if top.skel is None else self.skeleton.children[top.skel].get(path[d * WIDTH : (d + 1) * WIDTH])
                stack.append(Node(top, skel, chars[d]))
            self.path = path
        end = stack[-1]
        end.convs += 1
        if end.least is None or conv_id < end.least:
            end.least = conv_id
        if end.skel is not None:
            end.ids.append(conv_id)
            if len(end.ids) >= IDS:
                self._send(end)
        elif end.sha is None:
            end.sha = hashlib.sha256(str(conv_id).encode())
        else:
            end.sha.update(f",{conv_id}".encode())

    def finish(self) -> None:
        while self.stack:
            self._close()

    def _send(self, node: Node) -> None:
        if node.ids:
            self.out.append(self._row("ends", skel=node.skel, text=",".join(map(str, node.ids)), seq=node.sent))
            node.ids, node.sent = [], node.sent + 1

    def _row(self, kind: str, **values) -> dict:
        return {"kind": kind, "shard": self.number} | values

    def _close(self) -> None:
        """The last node of the stack has all its members: what it holds goes to its parent."""
        node = self.stack.pop()
        up = node.parent
        if up:
            up.convs += node.convs
            up.least = node.least if up.least is None or (node.least is not None and node.least < up.least) else up.least
        if node.skel is not None:  # its parent adds up its children from the skeleton
            self._send(node)
            if node.convs:
                self.out.append(self._row("part", skel=node.skel, conv_id=node.least, n_convs=node.convs, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, chars=node.chars))
            return
        node.leaves = node.leaves or 1
        node.saved += (node.convs - 1) * node.chars
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
        self.done.append(node)
        if up.skel is not None:  # a whole subtree is finished: parents are known
            for n in self.done:
                top = n.parent.skel
                sha = (n.sha or hashlib.sha256()).hexdigest()
                self.out.append(self._row("node", skel=top, conv_id=n.least, depth=n.depth, parent_conv_id=n.parent.least if top is None else None, n_convs=n.convs, n_children=n.children, n_leaves=n.leaves, saved_tokens=n.saved, text=sha))
            self.done = []


def _local(rows: DataFrame, cuts: list[tuple[bytes, int]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cuts)  # SKELETON_BYTES at most

    def dealt(batches):
        for batch in batches:
            places = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield batch.append_column("shard", pa.array([bisect_right(shared.value, p) for p in places], pa.int32()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        skeleton, shard = Skeleton(shared.value), None
        for batch in batches:
            for number, conv_id, path, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "chars"))):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                        yield pa.RecordBatch.from_pylist(shard.out, _SCHEMA)
                    shard = Shard(skeleton, number)
                shard.add(conv_id, path, chars)
                if len(shard.out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(shard.out, _SCHEMA)
                    shard.out = []
        if shard is not None:
            shard.finish()
            yield pa.RecordBatch.from_pylist(shard.out, _SCHEMA)

    placed = rows.mapInArrow(dealt, "conv_id long, path binary, chars array<int>, shard int")
    return placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, LOCAL)


def _own_members(ends: DataFrame) -> DataFrame:
    """skel, ends_sha256: chunks of ids in the order of shards go through the hash one after the other, as a hash must."""

    def run(batches):
        at, sha = None, None
        for batch in batches:
            for skel, text in zip(batch.column("skel").to_pylist(), batch.column("text").to_pylist()):
                if skel != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"skel": at, "ends_sha256": sha.hexdigest()}])
                    at, sha = skel, hashlib.sha256(text.encode())
                else:
                    sha.update(f",{text}".encode())
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"skel": at, "ends_sha256": sha.hexdigest()}])

    return ends.select("skel", "shard", "seq", "text").repartition("skel").sortWithinPartitions("skel", "shard", "seq").mapInArrow(run, "skel long, ends_sha256 string")


def trie(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """RESULT of every node; rows: conv_id, path, chars (see paths)."""
    spark = rows.sparkSession
    rows = written(rows, "paths")
    if shards is None:
        turns = rows.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
        shards = max(turns // SHARD_TURNS + 1, 2 * spark.sparkContext.defaultParallelism)
    cuts = splitters(rows, shards)
    local = written(_local(rows, cuts), "trie")
    skeleton = Skeleton(cuts)
    parts = local.filter("kind = 'part'").groupBy("skel").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("convs"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"))
    found = parts.join(_own_members(local.filter("kind = 'ends'")), "skel", "left").collect()  # a row a node of the skeleton: SKELETON_BYTES / WIDTH at most
    none = hashlib.sha256().hexdigest()
    nodes = {r["skel"]: r.asDict() for r in found}
    for i in sorted(nodes, key=lambda n: -skeleton.depth[n]):
        n = nodes[i]
        n["leaves"] = n["leaves"] if n["children"] else 1
        n["saved"] += (n["convs"] - 1) * n["chars"]
        if i:
            up = nodes[skeleton.parent[i]]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + n["leaves"], up["saved"] + n["saved"]
    whole = [(i, n["least"], skeleton.depth[i], nodes[skeleton.parent[i]]["least"] if i else None, n["convs"], n["children"], n["leaves"], n["saved"], n["ends_sha256"] or none) for i, n in nodes.items()]
    top = spark.createDataFrame(whole, "skel long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    above = F.broadcast(top.select("skel", F.col("conv_id").alias("_above")))
    done = local.filter("kind = 'node'").withColumnRenamed("text", "ends_sha256").join(above, "skel", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return done.select(RESULT).union(top.select(RESULT))


def rebuilt_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of conversations whose first h turns, h = crc32(id) % 6, are those of the conversation id - id % 100."""
    c = F.col("conv_id")
    return trie(rebuilt(conversations, c - c % 100, F.crc32(c.cast("string")) % 6, 5), shards)
