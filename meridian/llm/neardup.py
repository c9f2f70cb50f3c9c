"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has `PARTS` symbols of 16 bits. It is split into chunks; two signatures that differ in at most `errors`
symbols have, by the pigeonhole principle, a chunk with at most errors // chunks = 1 differing symbol. Each chunk is
therefore entered under every way of leaving one symbol out, and equal entries meet. `layout` takes as many errors as
a pair at the least similarity exceeds with a probability of at most 1e-6: 33 in 17 chunks at 0.85, 40 in 21 at 0.8.

Work is done on classes of equal shingle sets. In each bucket of entries, members are compared with the bucket's
leader, first by their signatures' distance and then in full, which links most of a group of copies with as many
comparisons as it has members; buckets whose members are then in one component are done. Texts of the buckets that are
left are compared in full, between components only, where the rarest shingles that a partner would have to share meet.
No link between different sets is lost by that.

Null and empty texts have no shingles and are linked with nothing, and so are rows whose id is null. Fewer words than a
shingle make one shingle. Rows that repeat an id with the same text get the same result; different texts under one id
are compared each for itself. An empty table gives an empty result. Columns other than id and text are left alone.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bytescan import Words, chunks, mix
from .common import written
from .graph import components

PARTS, LOST = 96, 1e-6
LEADER_ROUNDS = 2
#: Partners of a set up to which one copy of it serves, and parts in which the pairs of one learn its copies.
PARTNERS, SALTS = 64, 16
BAND = 1.05
_rng = np.random.Generator(np.random.PCG64(96))
_MULTIPLY = _rng.integers(1, 2**31, PARTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, PARTS, dtype=np.uint32)


def layout(percent: int) -> tuple[int, int]:
    """(errors, chunks) at which a pair of that similarity is lost with a probability of at most LOST."""
    p, over, errors = 1 - percent / 100, 0.0, PARTS
    while errors and (more := over + math.comb(PARTS, errors) * p**errors * (1 - p) ** (PARTS - errors)) <= LOST:
        over, errors = more, errors - 1
    chunks = errors // 2 + 1
    if PARTS // chunks < 3:
        raise ValueError(f"{PARTS} symbols are too few for pairs at {percent} %")
    return errors, chunks


def signature(shingles: np.ndarray) -> np.ndarray:
    """PARTS symbols of a set of distinct 64-bit hashes."""
    low = np.full(PARTS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 4096):
        low = np.minimum(low, ((h[i : i + 4096, None] ^ _FLIP) * _MULTIPLY).min(axis=0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each text that has a word."""
    for lo, buf, offs in chunks(texts):
        w = Words(buf, offs)
        h, row = w.shingles(k)
        ends = np.cumsum(np.bincount(row, minlength=w.rows)) if len(row) else np.zeros(w.rows, np.int64)
        for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            yield lo + i, np.unique(h[a:b])


def _sign(batches, k):
    for batch in batches:
        n, cls, sig = [], [], []
        for _, s in _sets(batch.column("text"), k):
            n.append(len(s))
            cls.append(_class(s))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "class", "sig"])


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_sign, k=k), "doc_id long, n_shingles long, class binary, sig binary")


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _full(batches, k):
    """The sets of those texts that are of the class they are asked for."""
    for batch in batches:
        rows = [s for _, s in _sets(batch.column("text"), k)]
        mine = [i for i, (s, c) in enumerate(zip(rows, batch.column("class").to_pylist())) if _class(s) == c]
        rows, batch = [rows[i].view(np.int64) for i in mine], batch.take(pa.array(mine, pa.int64()))
        step = max(1, len(rows) // 8)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            offs = np.cumsum([0, *map(len, part)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, step), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(part)))], ["rep", "shingles"])


def _enter(batches, chunks):
    chunk = np.repeat(np.arange(chunks), [PARTS // chunks + (c < PARTS % chunks) for c in range(chunks)])
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    for batch in batches:
        for i in range(0, len(batch), 2048):
            part = batch.slice(i, 2048)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.uint64)
            term = mix(sig + (np.arange(PARTS, dtype=np.uint64) << np.uint64(16)))
            total = np.add.reduceat(term, first, axis=1)
            key = mix(total[:, chunk] - term + np.arange(PARTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column("rep").to_numpy(), PARTS))], ["key", "rep"])


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with table's column of each side, as x and y.

    A rep with many partners is copied once for every PARTNERS of them, so that no task meets them all.
    """
    copies = pairs.groupBy("a").agg((F.count(F.lit(1)) / PARTNERS).cast("long").alias("copies"))
    many = copies.filter("copies > 0").select(F.col("a").alias("_a"), "copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    p = pairs.join(many, (F.col("a") == F.col("_a")) & (salt == F.col("_s")), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies") + 1), F.lit(0)).alias("copy"))
    one = table.join(copies, F.col("rep") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), "copies")).alias("copy"), F.col(column).alias("x"))
    return p.join(one, ["a", "copy"]).drop("copy").join(table.select(F.col("rep").alias("b"), F.col(column).alias("y")), "b")


def _near(batches, errors):
    """Those of pairs (a, b, x, y) whose signatures x and y differ in at most `errors` symbols."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PARTS) for c in "xy")
        yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= errors))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    p = _both(pairs, sets, "shingles").withColumns({"nx": F.size("x"), "ny": F.size("y")})
    p = p.filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("a", "b", (F.col("nx") + F.col("ny")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return p.filter(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("a", "b").distinct()


def _open(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries, with comp, of the buckets whose members are in several components."""
    e = entries.join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    split = e.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return e.join(split, "key")


def _prefix_pairs(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from different components that can be similar enough; a is the smaller set.

    Shingles are ordered by how few of the texts hold them; one of a single text takes a place and meets nothing.
    Sets of na <= nb shingles must share at least `need` = ceil(t / (1 + t) (na + nb)) of them, so the first one they
    share stands within the first na - need + 1 of the one and nb - need + 1 of the other. As nb >= na, the smaller
    enters only n - ceil(2t / (1 + t) n) + 1 shingles, the larger n - ceil(t n) + 1. Lengths and places meet before texts
    do, then components, so texts of one component and texts that the bounds keep apart are never paired.
    """
    comp = entries.select("rep", "comp").distinct()
    mine = sets.join(comp, "rep").select("rep", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    often = mine.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = mine.join(often, "h").withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("df", "h")))
    first = written(ranked.filter((F.col("df") > 1) & (F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("h", "rep", "comp", "n", "i"), "prefixes")
    one, two = (first.select("h", F.col("rep").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    one = one.filter(F.col("ia") <= F.col("na") - F.ceil(F.col("na") * 2 * percent / (100 + percent)) + 1)
    met = written(_meeting(one, two, percent), "meeting")
    groups = met.join(one.select("h", "na", "ia", "ca").distinct(), ["h", "na", "ia"]).join(two.select("h", "nb", "ib", "cb").distinct(), ["h", "nb", "ib"]).filter("ca <> cb")
    pairs = groups.join(one, ["h", "na", "ia", "ca"]).join(two, ["h", "nb", "ib", "cb"])
    return pairs.filter("na < nb or a < b").select("a", "b").distinct()


def _meeting(one: DataFrame, two: DataFrame, percent: int) -> DataFrame:
    """(h, na, ia, nb, ib): lengths and places of a shingle h that pairs of different components can have.

    Texts of one length that hold h in one place are one row here, so a shingle of very many texts meets itself by the
    lengths that occur, not by the texts. need <= n - i + 1 bounds what both lengths may add up to; bands of lengths,
    each BAND times as long as the one before, make the range of partners an equi-join.
    """
    total = lambda x: F.floor((F.col(f"n{x}") - F.col(f"i{x}") + 1) * (100 + percent) / percent)
    band = lambda n: F.floor(F.log(n) / math.log(BAND))
    cells = lambda t, x: t.groupBy("h", f"n{x}", f"i{x}").agg(F.min(f"c{x}").alias(f"least_{x}"), F.max(f"c{x}").alias(f"most_{x}"))
    small = cells(one, "a").withColumn("longest", total("a") - F.col("na")).filter("longest >= na")
    small = small.withColumn("band", F.explode(F.sequence(band("na"), band("longest"))))
    large = cells(two, "b").withColumns({"band": band("nb"), "others": total("b") - F.col("nb")})
    apart = "(least_a < most_a or least_b < most_b or least_a <> least_b)"
    return small.join(large, ["h", "band"]).filter(f"na <= nb and nb <= longest and na <= others and {apart}").select("h", "na", "ia", "nb", "ib")


def links(docs: DataFrame, signed: DataFrame, percent: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(class, rep) of every set and (u, root) of the reps that are linked to a smaller one."""
    errors, chunk_count = layout(percent)
    classes = signed.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    # different texts under one id: all but one of them get an id that no row has
    same = Window.partitionBy("rep").orderBy("class")
    classes = written(classes.withColumn("doc_id", F.col("rep")).withColumn("rep", F.when(F.row_number().over(same) == 1, F.col("rep")).otherwise(F.xxhash64("class"))), "classes")
    keys = classes.select("rep", "sig").mapInArrow(partial(_enter, chunks=chunk_count), "key long, rep long")
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = written(keys.join(many, "key"), "entries")
    pop = written(entries.groupBy("rep").agg(F.sum("n").alias("pop")), "popularity")
    sigs = classes.select("rep", "sig")
    asked = classes.join(pop, "rep").select("rep", "class", F.col("doc_id").alias("_id"))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, F.col("doc_id") == F.col("_id")).select("rep", "class", "text")
    sets = mine.mapInArrow(partial(_full, k=k), "rep long, shingles array<long>")
    if not signed.groupBy("doc_id", "class").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["rep"])  # rows that repeat both id and text
    sets = written(sets, "sets")
    rows = written(entries.select("key", "rep").join(pop, "rep"), "ranked")
    found = sets.sparkSession.createDataFrame([], "a long, b long")
    roots = sets.sparkSession.createDataFrame([], "u long, root long")
    for _ in range(LEADER_ROUNDS):
        lead = rows.groupBy("key").agg(F.max(F.struct("pop", "rep")).alias("top")).select("key", F.col("top.rep").alias("leader"))
        led = rows.join(lead, "key")
        pairs = written(led.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
        near = written(_both(pairs, sigs, "sig").mapInArrow(partial(_near, errors=errors), "a long, b long"), "near")
        found = written(found.union(_confirmed(near, sets, percent)), "links")
        roots = components(found)
        rows = written(_open(led.filter("rep <> leader").drop("leader", "comp"), roots), "open")
        if rows.isEmpty():
            return classes, roots
    pairs = written(_prefix_pairs(rows, sets, percent), "pairs")
    found = written(found.union(_confirmed(pairs, sets, percent)), "links")
    return classes, components(found)


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept: a row for each row of docs."""
    signed = written(signatures(docs, k), "signatures")
    classes, roots = links(docs, signed, percent, k)
    home = classes.join(roots, F.col("rep") == F.col("u"), "left").select("class", "doc_id", F.coalesce("root", "rep").alias("home"))
    least = home.groupBy("home").agg(F.min("doc_id").alias("least"))
    home = home.join(least, "home").select(F.col("class").alias("_c"), "least")
    out = signed.select("doc_id", "n_shingles", "class").join(home, (F.col("class") == F.col("_c")) & F.col("doc_id").isNotNull(), "left")
    comp = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
