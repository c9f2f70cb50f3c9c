"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision has a context tree over the up to DEPTH bytes before it; every
node keeps counts of zeros and ones and a Krichevsky-Trofimov estimate, and each depth is weighted with all deeper
ones. The model is frozen after training: a text's probability mixes the estimates of all depths of its path by
their posterior weights, down to the deepest node that training met. Before each byte stands one more decision, whether
the text ends there, with a tree over the two bytes before; so the probabilities of all texts of any length sum to 1.

Weighting and mixing of nodes of up to SHALLOW bytes are joins and aggregations; the deeper nodes below one of SHALLOW
bytes are in one bucket and are made there, twice, instead of written. Texts are scored in blocks of BLOCK_BYTES: a
block asks for the grams and words it holds and gets their values back in the order in which it asked, in packed
arrays by bucket, so no task ever needs the whole model. Texts and questions are written once, in buckets, and not
shuffled again.

Null and empty texts are one end token; their score is that of ending at once. Without training rows every decision
has probability 1/2 and no token is known. Repeated rows score alike; an empty table gives an empty result. A very
long text is a block of its own. Words are told apart by 64-bit hashes. Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import Words, chunks, mix
from .common import bucketed, written

DEPTH = 6
#: Bytes of context up to which nodes are tables; deeper ones are arrays of one of LEAST_BUCKETS buckets, or one per BUCKET_BYTES of texts.
SHALLOW = 3
LEAST_BUCKETS, BUCKET_BYTES = 64, 8 << 20
BLOCK_BYTES = 24 << 20
#: Files of a table; buckets beyond share them.
LEAST_FILES, MOST_FILES = 12, 50_000
END = np.int64(0x7E57E2D0C0FFEE11)


def grams(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The depth + 1 bytes that end at each byte, as one integer; zeros stand before a text's start."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(len(buf)) + depth * (row + 1)
    wide = np.zeros(len(buf) + depth * (len(offs) - 1), np.uint64)
    wide[at] = buf
    code = wide[at]
    for j in range(1, depth + 1):
        code |= wide[at - j] << np.uint64(8 * j)
    return code.view(np.int64)


def _blocks(batches, size):
    block, held = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([block] * len(part), pa.int64())], [*part.schema.names, "block"])
            held += part.column("text").nbytes
            if held >= size:
                block, held = block + 1, 0


class _Tally:
    """Distinct keys of a block with how often training texts hold them."""

    def __init__(self):
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for part, counts in ((keys[train], True), (keys[~train], False)):
            if len(part):
                k, n = np.unique(part, return_counts=True)
                self.put(k, n if counts else np.zeros(len(k), np.int64))

    def put(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Sorted distinct keys and their counts."""
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size > 6_000_000:
            self.size = len(self.fold()[0]) // 2

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys, n = np.concatenate([np.zeros(0, np.int64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.n])
            order = np.argsort(keys, kind="stable")  # of sorted runs
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            self.keys, self.n = [keys[first]], [np.add.reduceat(n, first) if len(first) else n]
        return self.keys[0], self.n[0]


def packed(x: np.ndarray) -> bytes:
    """An array of numbers by planes of their bytes, compressed; sorted grams take few bytes each."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, dtype=np.int64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, width * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(dtype).ravel()


PACKED = "block long, bucket long, size long, keys binary, n binary"
PACKED_NAMES = ["block", "bucket", "size", "keys", "n"]


def _dealt(word: bool, keys: np.ndarray, top: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by bucket, and where each bucket begins. Grams are dealt by the top bytes before their last."""
    part = mix((keys if word else (keys >> 8) & _mask(top)).view(np.uint64)) % np.uint64(buckets)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(buckets + 1))


def _packs(block: int, word: bool, keys: np.ndarray, n: np.ndarray, top: int, buckets: int) -> list[tuple]:
    """Rows of PACKED from sorted distinct keys: words in buckets below 0."""
    order, cut = _dealt(word, keys, top, buckets)
    return [(block, -1 - int(i) if word else int(i), len(at := order[cut[i] : cut[i + 1]]), packed(keys[at]), packed(n[at])) for i in np.flatnonzero(np.diff(cut))]


def _packed_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 3 + [pa.binary()] * 2)], names=PACKED_NAMES)


def _gathered(texts, train: np.ndarray, depth: int) -> tuple[_Tally, _Tally]:
    words, found = _Tally(), _Tally()
    for lo, buf, offs in chunks(texts):
        t = train[lo : lo + len(offs) - 1]
        w = Words(buf, offs)
        words.add(np.r_[w.hash.view(np.int64), np.full(len(t), END)], np.r_[t[w.row], t])
        if len(buf):
            found.add(grams(buf, offs, depth), np.repeat(t, np.diff(offs)))
    return words, found


def _ask(t: pa.Table, depth: int, top: int, buckets: int) -> pa.Table:
    block = t.column("block")[0].as_py()
    words, found = _gathered(t.column("text"), t.column("train").to_numpy(), depth)
    return _packed_table(_packs(block, True, *words.fold(), top, buckets) + _packs(block, False, *found.fold(), top, buckets))


def _lgamma(x, log=np.log):
    """ln gamma of x >= 1/2: Stirling's series at x + 6."""
    y = x + 6
    down = log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - down


def _evidence(n0, n1, log=np.log):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5, log) + _lgamma(n1 + 0.5, log) - _lgamma(n0 + n1 + 1.0, log) - math.log(math.pi)


def _mask(depth: int) -> int:
    return (1 << 8 * depth) - 1


def _up(node, depth: int):
    """The node with a context of depth bytes above one of more: a column or an array."""
    if isinstance(node, Column):
        return F.shiftleft(F.shiftright(node, 8).bitwiseAND(F.lit(_mask(depth)).cast("long")), 8) + node.bitwiseAND(255)
    return (((node >> 8) & _mask(depth)) << 8) | (node & 255)


def _nodes(key: np.ndarray, j: int) -> np.ndarray:
    """Node of a gram's decision j: its context and the byte's first j bits after a one."""
    return (key >> 8 << 8) | (1 << j) | ((key & 255) >> (8 - j))


def _shorter(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each depth down to top: sorted distinct grams and their counts."""
    out = {depth: (key, n)}
    for k in range(depth - 1, top - 1, -1):
        g, inv = np.unique(out[k + 1][0] & _mask(k + 1), return_inverse=True)
        out[k] = g, np.bincount(inv, out[k + 1][1], len(g))
    return out


def _tree(short: dict, depth: int, top: int, j: int) -> dict[int, dict[str, np.ndarray]]:
    """For each depth from top: nodes of decision j, sorted, with counts, weights and the place of each one's parent."""
    out: dict[int, dict[str, np.ndarray]] = {}
    for k in range(depth, top - 1, -1):
        g, n = short[k]
        all_ = _nodes(g, j)
        new = np.r_[True, all_[1:] != all_[:-1]]
        first = np.flatnonzero(new)
        node = all_[first]
        n1 = np.add.reduceat(n * ((g >> (7 - j)) & 1), first).astype(float)
        n0 = np.add.reduceat(n, first) - n1
        pe = _evidence(n0, n1)
        pw, w = pe, np.ones(len(node))
        if k < depth:
            below = out[k + 1]
            below["parent"] = np.searchsorted(node, _up(below["node"], k))
            pw = math.log(0.5) + np.logaddexp(pe, np.bincount(below["parent"], below["pw"], len(node)))
            w = np.exp(math.log(0.5) + pe - pw)
        out[k] = {"node": node, "pw": pw, "w": w, "kt": (n1 + 0.5) / (n0 + n1 + 1), "n0": n0, "n1": n1, "at": np.cumsum(new) - 1}
    return out


def _bucket(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row, and the distinct keys of all with their counts."""
    size, each = t.column("size").to_pylist(), []
    tally = _Tally()
    for keys, n, m in zip(t.column("keys"), t.column("n"), size):
        each.append(unpacked(keys.as_py(), m))
        tally.put(each[-1], unpacked(n.as_py(), m))
    return each, *tally.fold()


def _rows(kind: int, bucket: int, node: np.ndarray, *rest: np.ndarray) -> pa.Table:
    rest = rest or [np.zeros(len(node))] * 5
    return pa.table([pa.array(np.full(len(node), kind, np.int32)), pa.array(np.full(len(node), bucket)), pa.array(node), *map(pa.array, rest)], names=["kind", "bucket", "node", "pw", "w", "kt", "n0", "n1"])


NODES = "kind int, bucket long, node long, pw double, w double, kt double, n0 double, n1 double"
TREE, MISSED, COUNT = 0, 1, 2


def _grown(t: pa.Table, depth: int, top: int) -> pa.Table:
    """TREE: the nodes at depth top above a bucket's grams, weighted with all deeper ones. MISSED: those that are asked for, but not met in training. COUNT: how many words, and how many different ones, a bucket of words has."""
    bucket = t.column("bucket")[0].as_py()
    _, key, n = _bucket(t)
    if bucket < 0:
        return _rows(COUNT, bucket, np.zeros(1, np.int64), *np.array([[0.0], [0.0], [0.0], [n.sum()], [(n > 0).sum()]]))
    out, seen = [], key[n > 0]
    short = _shorter(seen, n[n > 0], depth, top)
    want = np.unique(key[n == 0] & _mask(top + 1))
    for j in range(8):
        x = _tree(short, depth, top, j)[top] if len(seen) else {"node": seen}
        if len(seen):
            out.append(_rows(TREE, bucket, x["node"], *(x[c] for c in ("pw", "w", "kt", "n0", "n1"))))
        out.append(_rows(MISSED, bucket, np.setdiff1d(_nodes(want, j), x["node"])))
    return pa.concat_tables(out)


VALUED = "block long, bucket long, size long, keys binary, value binary"
NO_VALUES = pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["block", "bucket", "size", "keys", "value"])


def _valued(t: pa.Table, mixed: pa.Table, depth: int, top: int, echo: bool) -> pa.Table:
    """For each row of a bucket the values of its keys: counts of words, logarithms for grams; with the keys only where echo is set."""
    if not len(t):
        return NO_VALUES
    each, key, n = _bucket(t)
    word = t.column("bucket")[0].as_py() < 0
    value = n if word else _values(key, n, mixed, depth, top).astype(np.float32)
    back = [packed(value[np.searchsorted(key, k)]) for k in each]
    keys = t.column("keys") if echo else pa.nulls(len(t), pa.binary())
    return pa.table([t.column("block"), t.column("bucket"), t.column("size"), keys, pa.array(back, pa.binary())], names=["block", "bucket", "size", "keys", "value"])


def _values(key: np.ndarray, n: np.ndarray, mixed: pa.Table, depth: int, top: int) -> np.ndarray:
    node, a_, b_ = (mixed.column(c).to_numpy() for c in ("node", "a", "b"))
    order = np.argsort(node)
    node, a_, b_ = node[order], a_[order], b_[order]
    seen, asked = key[n > 0], key[n == 0]
    short = _shorter(seen, n[n > 0], depth, top)
    value = np.zeros(len(key))
    for j in range(8):
        p = a_[np.searchsorted(node, _nodes(asked & _mask(top + 1), j))]
        if len(seen):
            tree = _tree(short, depth, top, j)
            at = np.searchsorted(node, tree[top]["node"])
            a, b = a_[at], b_[at]
            for k in range(top, depth + 1):
                x = tree[k]
                if k > top:
                    a, b = a[x["parent"]], b[x["parent"]]
                end = a + b * x["kt"]
                want = _nodes(asked & _mask(k + 1), j)
                at = np.minimum(np.searchsorted(x["node"], want), len(end) - 1)
                p = np.where(x["node"][at] == want, end[at], p)
                a, b = a + b * x["w"] * x["kt"], b * (1 - x["w"])
            one = end[tree[depth]["at"]]
            value[n > 0] += np.log10(np.where((seen >> (7 - j)) & 1, one, 1 - one))
        value[n == 0] += np.log10(np.where((asked >> (7 - j)) & 1, p, 1 - p))
    return value


def _weighted(asked: DataFrame, depth: int, top: int, echo: bool = False) -> tuple[DataFrame, int, int]:
    """VALUED for each row of PACKED, and how many words, and different ones, training has.

    Grams with the same `top` bytes before their last are in one bucket, whose deeper nodes are arrays of one task and
    are never written. Only the nodes of `top` bytes and fewer are tables.
    """
    grown = written(asked.groupBy("bucket").applyInArrow(lambda t: _grown(t, depth, top), NODES), "ctw")
    words = grown.filter(F.col("kind") == COUNT).agg(F.sum("n0").alias("n"), F.sum("n1").alias("v")).first()
    levels = [grown.filter(F.col("kind") == TREE).drop("kind")]
    half = math.log(0.5)
    for k in range(top - 1, -1, -1):
        level = levels[0].groupBy(_up(F.col("node"), k).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        level = level.withColumn("pe", _evidence(F.col("n0"), F.col("n1"), F.log))
        high = F.greatest("pe", "below")
        level = level.withColumn("pw", half + high + F.log1p(F.exp(F.least("pe", "below") - high)))
        kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        levels.insert(0, written(level.select("node", "pw", F.exp(half + F.col("pe") - F.col("pw")).alias("w"), kt.alias("kt"), "n0", "n1"), "ctw"))
    mixed = [levels[0].withColumn("a", F.lit(0.0)).withColumn("b", F.lit(1.0))]
    for k in range(1, top + 1):
        above = mixed[-1].select(F.col("node").alias("_up"), (F.col("a") + F.col("b") * F.col("w") * F.col("kt")).alias("a"), (F.col("b") * (1 - F.col("w"))).alias("b"))
        mixed.append(written(levels[k].join(above, _up(F.col("node"), k - 1) == F.col("_up")).drop("_up"), "ctw-mixed"))
    last = mixed[top].select("bucket", "node", "a", "b")
    open_ = grown.filter(F.col("kind") == MISSED).select("bucket", "node")
    for k in range(top - 1, -1, -1):
        ends = mixed[k].select(F.col("node").alias("_n"), (F.col("a") + F.col("b") * F.col("kt")).alias("a"))
        j = written(open_.join(ends, _up(F.col("node"), k) == F.col("_n"), "left").drop("_n"), "ctw-open")
        last = last.union(j.filter("a is not null").select("bucket", "node", "a", F.lit(0.0)))
        open_ = j.filter("a is null").drop("a")
    last = last.union(open_.select("bucket", "node", F.lit(0.5), F.lit(0.0)))
    valued = asked.groupBy("bucket").cogroup(last.groupBy("bucket")).applyInArrow(lambda t, m: _valued(t, m, depth, top, echo), VALUED)
    return valued, int(words.n or 0), int(words.v or 0)


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): log10 of the probability of a gram's last byte after the others."""
    top = min(depth, SHALLOW)

    def pack(batches):
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            order = np.argsort(key)
            yield from _packed_table(_packs(0, False, key[order], n[order], top, LEAST_BUCKETS)).to_batches()

    def unpack(batches):
        for batch in batches:
            for size, keys, value in zip(*(batch.column(c).to_pylist() for c in ("size", "keys", "value"))):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(keys, size)), pa.array(unpacked(value, size, np.float32).astype(float))], ["key", "value"])

    return _weighted(written(counts.select("key", "n").mapInArrow(pack, PACKED), "asked"), depth, top, True)[0].mapInArrow(unpack, "key long, value double")


def _places(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bytes before each byte and before each text's end, as numbers; zeros stand before a text's start."""
    one, two = np.r_[0, buf].astype(np.int64), np.r_[0, 0, buf].astype(np.int64)
    start, end = offs[:-1], offs[1:]
    last = np.where(end > start, one[end], 0) + (np.where(end > start + 1, two[end], 0) << 8)
    one, two = one[: len(buf)], two[: len(buf)]
    some = start[end > start]
    one[some] = two[some] = 0
    two[some[some + 1 < len(buf)] + 1] = 0
    return one + (two << 8), last


def end_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """How often training texts (text, train) go on and end after each two bytes, and the bytes of all texts."""
    def run(batches):
        on, end, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for lo, buf, offs in chunks(batch.column("text")):
                t, size = train[lo : lo + len(offs) - 1], size + len(buf)
                before, last = _places(buf, offs)
                on += np.bincount(before[np.repeat(t, np.diff(offs))], minlength=1 << 16)
                end += np.bincount(last[t], minlength=1 << 16)
        at = np.flatnonzero(on + end)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[on[at], size]), pa.array(np.r_[end[at], 0])], ["place", "on", "end"])

    rows = docs.select("text", "train").mapInArrow(run, "place long, on long, end long").groupBy("place").agg(F.sum("on").alias("on"), F.sum("end").alias("end")).collect()  # 65,537 at most
    on, end = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in rows:
        if r.place >= 0:
            on[r.place], end[r.place] = r.on, r.end
    return on, end, sum(r.on for r in rows if r.place < 0)


def end_logs(on: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log10 of the probabilities to go on and to end after each two bytes, by a context tree of depth two."""
    levels = [(x.reshape(256, 256), y.reshape(256, 256)) for x, y in ((on, end),)]
    levels.append(tuple(x.sum(0) for x in levels[0]))
    levels.append(tuple(x.sum() for x in levels[1]))
    below, mixed = None, []
    for n0, n1 in levels:
        pe = _evidence(n0, n1)
        pw = pe if below is None else math.log(0.5) + np.logaddexp(pe, below.sum(0))
        w = np.exp(math.log(0.5) + pe - pw) if below is not None else np.ones_like(pe)
        below = np.where(n0 + n1 > 0, pw, 0.0)
        mixed.append((n0 + n1 > 0, w, (n1 + 0.5) / (n0 + n1 + 1)))
    a, b, p = 0.0, 1.0, 0.5
    for met, w, kt in reversed(mixed):
        p = np.where(met, a + b * kt, p)
        a, b = np.where(met, a + b * w * kt, a), np.where(met, b * (1 - w), b)
    return np.log10(np.array([1 - p, p]).reshape(2, -1))


class _Lookup:
    """Values by distinct keys. Only keys that it holds may be asked for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = mix(keys.view(np.uint64))
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order]
        bits = max(len(keys), 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.mixed, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mixed = mix(keys.view(np.uint64))
        at = self.start[mixed >> self.shift]
        late = np.flatnonzero(self.mixed[at] != mixed)
        while len(late):
            at[late] += 1
            late = late[self.mixed[at[late]] != mixed[late]]
        return self.values[at]


def _score(docs: pa.Table, values: pa.Table, depth: int, top: int, buckets: int, total: int, kinds: int, ends: np.ndarray) -> pa.Table:
    back = dict(zip(values.column("bucket").to_pylist(), zip(values.column("size").to_pylist(), values.column("value"))))
    look = []
    for word, tally in zip((True, False), _gathered(docs.column("text"), np.ones(len(docs), bool), depth)):
        keys, dtype = tally.fold()[0], np.int64 if word else np.float32
        order, cut = _dealt(word, keys, top, buckets)
        value = np.zeros(len(keys), dtype)
        for i in np.flatnonzero(np.diff(cut)):
            size, data = back[-1 - i if word else i]
            value[order[cut[i] : cut[i + 1]]] = unpacked(data.as_py(), size, dtype)
        look.append(_Lookup(keys, value))
    rows = []
    for lo, buf, offs in chunks(docs.column("text")):
        w, n = Words(buf, offs), len(offs) - 1
        c = look[0](np.r_[w.hash.view(np.int64), np.full(n, END)])
        row = np.r_[w.row, np.arange(n)]
        known = np.bincount(row, c > 0, n).astype(np.int64)
        base = np.bincount(row, np.log10((c + 1) / (total + kinds + 1)), n)
        before, last = _places(buf, offs)
        score = ends[1][last]
        if len(buf):
            g = look[1](grams(buf, offs, depth)) + ends[0][before]
            score = score + np.bincount(np.repeat(np.arange(n), np.diff(offs)), g, n)
        rows.append((w.count + 1, known, base, score, np.diff(offs)))
    cols = [np.concatenate(c) for c in zip(*rows)]
    return pa.table([docs.column("doc_id"), docs.column("train"), pa.array(cols[0]), pa.array(cols[1]), pa.array(np.full(len(docs), total)), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4])], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])


def scores(docs: DataFrame, train: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes of each row of docs (doc_id, text).

    score / n_bytes * log2(10) is the code length in bits per byte, with the sign turned.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    on, end, size = end_counts(d)
    top, buckets = min(depth, SHALLOW), max(LEAST_BUCKETS, size // BUCKET_BYTES)
    files = min(MOST_FILES, max(LEAST_FILES, 2 * size // block_bytes))
    d = bucketed(d.mapInArrow(partial(_blocks, size=block_bytes), "doc_id long, text string, train boolean, block long"), "text_blocks", files, "block")
    asked = d.groupBy("block").applyInArrow(lambda t: _ask(t, depth, top, buckets), PACKED)
    asked = bucketed(asked.repartition(min(MOST_FILES, buckets), "bucket"), "asked", min(MOST_FILES, buckets), "bucket")
    back, total, kinds = _weighted(asked, depth, top)
    run = partial(_score, depth=depth, top=top, buckets=buckets, total=total, kinds=kinds, ends=end_logs(on, end))
    return d.groupBy("block").cogroup(back.drop("keys").groupBy("block")).applyInArrow(lambda a, b: run(a, b), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
