"""Language identification with interpolated Kneser-Ney character models.

Models are over real code points of any script, lower-cased: n-grams of up to ORDER letters and marks within a word;
whatever else stands between two words is one boundary. Counts, continuation counts, discounts and back-off weights
come from every training row, and no n-gram is left out. The interpolated probabilities of each n-gram that any text
holds, learnt or not, are made order by order with joins, by language: a table of n-grams with their bits.

The most frequent n-grams, as many as make `hot_values` numbers, are broadcast as sorted arrays of 64-bit hashes with a
row of bits for each language. What a text holds beyond them, a small share of its n-grams by their rarity, is joined
with the table. So the result doesn't depend on hot_values, and nothing that grows with the corpus goes through the
driver.

The language of the lowest cross-entropy per character is chosen. One in CALIBRATION of the training ids stays out of
the counts; on these rows the temperature of the score is fitted, and a text is `rejected` when its cross-entropy lies
MARGIN times as far above their median in its language as the given quantile does.

Text without a letter, empty or null is `und` with score 0, null entropy, and rejected. Rows with a null lang aren't
learnt from. Without any training row every text is `und`; without calibration rows no other is rejected. Ties go to the
language that sorts first. Repeated rows are told alike, an empty table gives an empty result, long texts cost in
proportion. Columns other than doc_id, text and lang are left alone.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import mix
from .common import written

ORDER = 4
#: Numbers that are broadcast, 4 bytes each; fewer than MOST_HOT n-grams however few languages there are.
HOT_VALUES, MOST_HOT = 1 << 24, 1 << 19
REJECT_AT, MARGIN, CALIBRATION = 0.999, 1.5, 10
TEMPERATURES = [2.0**k for k in range(11)]
ROWS = 256
BOUNDARY = np.uint32(32)
LETTER, MARK = 1, 2
#: No letter is assigned beyond.
_LAST = 0x33FFF
_KIND = np.array([{"L": LETTER, "M": MARK}.get(unicodedata.category(chr(cp))[0], 0) for cp in range(_LAST)] + [0], np.uint8)
_PLACE = mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def grams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (the last first) of the n-gram that ends at each letter and at each word's end, its row, letters per row."""
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)[1:]
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    kind = _KIND[np.minimum(cp, _LAST)]
    letters = np.bincount(row[kind == LETTER], minlength=len(low))
    inside = kind > 0
    keep = inside | np.r_[False, inside[:-1]][: len(inside)]
    c, row = np.where(inside, cp, BOUNDARY)[keep], row[keep]
    out = np.full((ORDER, len(c)), BOUNDARY, np.uint32)
    out[0] = c
    for j in range(1, ORDER):
        out[j, j:] = c[: len(c) - j] if len(c) > j else []
        if j > 1:
            out[j][out[j - 1] == BOUNDARY] = BOUNDARY  # nothing is seen across a boundary
    return out, row, letters


def hashes(symbols: np.ndarray, start: int = 0) -> np.ndarray:
    """One number for each column of symbols (the last symbol first); start 1 leaves place 0 out, for contexts."""
    h = np.zeros(symbols.shape[1], np.uint64)
    for j in range(start, len(symbols)):
        h += symbols[j].astype(np.uint64) * _PLACE[j]
    return mix(h)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often docs (text, lang) hold each gram of ORDER symbols, the last symbol last; null is a lang too."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                h, s, n = (np.concatenate(x, axis=-1) for x in zip(*parts))
                _, first, inv = np.unique(h, return_index=True, return_inverse=True)
                total = np.bincount(inv, n, len(first)).astype(np.int64)
                strings = np.ascontiguousarray(s[::-1, first].T).view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(strings), pa.string()), pa.array(strings, pa.string()), pa.array(total)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                for i in range(0, len(mine), ROWS):
                    s, _, _ = grams(mine[i : i + ROWS])
                    h, first, n = np.unique(hashes(s), return_index=True, return_counts=True)
                    held.setdefault(lang, []).append((h, s[:, first], n))
                    size += len(h)
            if size > 1_000_000:
                yield from out()
                size = 0
        yield from out()

    return docs.filter("text is not null").select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _scattered(lists: pa.Array, field: str, out: np.ndarray) -> np.ndarray:
    """out with what each row's list of (at, field) says, at its places."""
    row, items = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
    out[row, items.field("at").to_numpy(zero_copy_only=False)] = items.field(field).to_numpy(zero_copy_only=False)
    return out


def estimates(table: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, n, p): each gram of table (lang, gram, n), how often it is met under any lang, null included, and its
    interpolated probability by language, in the order of langs, learnt from the rows of that lang."""
    levels = {ORDER: table}
    for k in range(ORDER - 1, 0, -1):  # continuations
        level = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = written(level, f"grams{k}")
    kinds = levels[1].filter("lang is not null").select("gram").distinct().count() + 1

    def interpolated(batches):
        for b in batches:
            size = (len(b), len(langs))
            own = _scattered(b.column("own"), "rest", np.zeros(size)) / _scattered(b.column("around"), "total", np.ones(size))
            lower = pc.list_flatten(b.column("lower")).to_numpy(zero_copy_only=False).reshape(size)
            p = own + _scattered(b.column("around"), "gamma", np.ones(size)) * lower
            lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * len(langs), p.ravel())
            yield pa.RecordBatch.from_arrays([b.column("gram"), b.column("n"), lists], ["gram", "n", "p"])

    out = None
    for k in range(1, ORDER + 1):
        one, two = (F.sum((F.col("n") == i).cast("long")) for i in (1, 2))
        per = levels[k].filter("lang is not null").groupBy("lang").agg(F.when((one > 0) & (two > 0), one / (one + 2 * two)).otherwise(0.5).alias("d"))
        per = per.withColumn("at", (F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int"))
        x = levels[k].join(F.broadcast(per), "lang", "left").select("at", "gram", F.substring("gram", 1, k - 1).alias("ctx"), "n", (F.col("n") - F.col("d")).alias("rest"))
        around = x.filter("at is not null").groupBy("ctx", "at").agg(F.sum("n").alias("total"), (1 - F.sum("rest") / F.sum("n")).alias("gamma"))
        around = around.groupBy("ctx").agg(F.collect_list(F.struct("at", "total", "gamma")).alias("around"))
        own = x.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "rest"))).alias("own"))
        rows = own.join(around, "ctx", "left")
        if k == 1:
            rows = rows.withColumn("lower", F.array_repeat(F.lit(1 / kinds), len(langs)))
        else:
            rows = rows.withColumn("ending", F.substring("gram", 2, k - 1)).join(out.select(F.col("gram").alias("ending"), F.col("p").alias("lower")), "ending")
        out = rows.select("gram", "n", "own", "around", "lower").mapInArrow(interpolated, "gram string, n long, p array<double>")
    return out


def least_hot(table: DataFrame, most: int) -> int:
    """The least n from which on table (n) has no more than `most` rows, to a twelfth of itself."""
    steps = table.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect()  # 8 an octave
    least = np.iinfo(np.int64).max
    for r in sorted(steps, reverse=True):
        most -= r.rows
        if most < 0:
            break
        least = r.n
    return int(least)


class HotGrams:
    """Sorted hashes of frequent n-grams and, for each language, their bits in the same order."""

    BITS = 20

    def __init__(self, strings: list[str], n: np.ndarray, bits: np.ndarray):
        h = hashes(np.array(strings, f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER).T[::-1])
        order = np.argsort(h)
        self.keys, self.bits = h[order], np.ascontiguousarray(bits[order].T, np.float32)
        often = np.argsort(n[order], kind="stable")
        self.first = np.zeros(1 << self.BITS, np.int32)  # where to look first: the most frequent of each range of hashes
        self.first[self._range(self.keys[often])] = often

    def _range(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of h, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at = self.first[self._range(h)]
        other = np.flatnonzero(self.keys[at] != h)
        at[other] = np.minimum(np.searchsorted(self.keys, h[other]), len(self.keys) - 1)
        return at, self.keys[at] == h


def hot_sums(docs: DataFrame, hot: HotGrams) -> DataFrame:
    """docs' columns but text, with letters, size (n-grams), bits (by language, of n-grams in hot), rare (the other n-grams and how often)."""
    held = docs.sparkSession.sparkContext.broadcast(hot)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        hot = held.value
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                m = len(part)
                s, row, letters = grams(part.column("text").to_pylist())
                h = hashes(s)
                at, there = hot.find(h)
                bits = np.array([np.bincount(row[there], b[at[there]], m) for b in hot.bits], float)  # of nothing it would be integers
                s, h, mine = s[:, ~there], h[~there], row[~there]
                order = np.lexsort((h, mine))
                new = np.flatnonzero(np.r_[True, (np.diff(mine[order]) != 0) | (np.diff(h[order]) != 0)][: len(h)])
                first = order[new]
                strings = np.ascontiguousarray(s[::-1, first].T).view(f"<U{ORDER}").ravel().tolist()
                times = np.diff(np.r_[new, len(h)])
                rare = pa.StructArray.from_arrays([pa.array(strings, pa.string()), pa.array(times, pa.int64())], ["gram", "times"])
                cols = [
                    pa.array(letters, pa.int64()), pa.array(np.bincount(row, minlength=m), pa.int64()),
                    pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * len(hot.bits), bits.T.ravel()),
                    pa.ListArray.from_arrays(np.searchsorted(mine[first], np.arange(m + 1)).astype(np.int32), rare),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *cols], [*others, "letters", "size", "bits", "rare"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    return docs.select(*others, "text").mapInArrow(run, f"{schema}, letters long, size long, bits array<double>, rare array<struct<gram: string, times: long>>")


def whole_sums(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (number, bits, rare, ...) with the bits of their rare n-grams added, from table (gram, bits of each language in b0, b1, ...)."""
    each = [c for c in table.columns if c != "gram"]
    rest = rows.select("number", F.explode("rare").alias("r")).select("number", "r.gram", "r.times").join(table, "gram")
    rest = rest.groupBy("number").agg(F.array(*[F.sum(F.col("times") * F.col(c)) for c in each]).alias("more"))
    added = F.zip_with("bits", "more", lambda a, b: a + b)
    return rows.drop("rare").join(rest, "number", "left").withColumn("bits", F.coalesce(added, "bits")).drop("more")


def calibrated(rows: DataFrame, langs: list[str]) -> float:
    """The temperature of the least log loss over rows (lang, gaps: nats between each language and the best)."""
    at = F.array_position(F.lit(langs), F.col("lang"))
    losses = []
    for t in TEMPERATURES:
        total = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / t))
        losses.append(F.sum(F.log(total) + F.get("gaps", (at - 1).cast("int")) / t).alias(f"t{t}"))
    loss = rows.filter(at > 0).agg(*losses).first()
    return min(zip(loss, TEMPERATURES))[1] if loss[0] is not None else 1.0


def identify(docs: DataFrame, train: Column, reject_at: float = REJECT_AT, hot_values: int = HOT_VALUES) -> DataFrame:
    """doc_id, trained (may have been learnt from), lang_pred, entropy, score, rejected for each row of docs (doc_id, text, lang)."""
    d = docs.select("doc_id", "text", "lang", F.coalesce(train, F.lit(False)).alias("trained"))
    d = d.withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0)
    counted = written(counts(d.select("text", F.when(F.col("trained") & ~F.col("apart"), F.col("lang")).alias("lang"))), "grams")
    langs = sorted(r.lang for r in counted.filter("lang is not null").select("lang").distinct().collect())
    if not langs:
        return d.select("doc_id", "trained", F.lit("und").alias("lang_pred"), F.lit(None).cast("double").alias("entropy"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    each = [(-F.log2(F.col("p")[i])).alias(f"b{i}") for i in range(len(langs))]
    table = written(estimates(counted, langs).select("gram", "n", *each), "bits")
    least = least_hot(table, min(MOST_HOT, hot_values // len(langs)))
    frequent = table.filter(F.col("n") >= least).toArrow()  # hot_values numbers at most
    bits = np.array([frequent.column(f"b{i}").to_numpy() for i in range(len(langs))]).T
    hot = HotGrams(frequent.column("gram").to_pylist(), frequent.column("n").to_numpy(), bits)
    rows = written(hot_sums(d.withColumn("number", F.monotonically_increasing_id()), hot), "sums")
    rows = whole_sums(rows, table.filter(F.col("n") < least).drop("n"))
    low, known = F.array_min("bits"), F.col("letters") > 0
    gaps = F.transform("bits", lambda b: (b - F.col("low")) * float(np.log(2)))
    rows = rows.withColumn("low", low).withColumn("gaps", gaps).select(
        "doc_id", "trained", "apart", "lang", "gaps", F.when(known, F.col("low") / F.col("size")).alias("entropy"),
        F.when(known, F.element_at(F.lit(langs), F.array_position("bits", F.col("low")).cast("int"))).otherwise("und").alias("lang_pred"),
    )
    rows = written(rows, "languages")
    held = rows.filter(F.col("trained") & F.col("apart") & F.col("lang").isNotNull())
    limit = held.filter("lang_pred <> 'und'").groupBy(F.col("lang_pred").alias("_lang")).agg(F.percentile_approx("entropy", [0.5, reject_at], 100_000).alias("_at"))
    limit = limit.select("_lang", (F.col("_at")[0] + MARGIN * (F.col("_at")[1] - F.col("_at")[0])).alias("_max"))
    temperature = calibrated(held, langs)
    und = F.col("lang_pred") == "und"
    score = F.when(und & F.col("entropy").isNull(), 0.0).otherwise(1 / F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / temperature)))
    found = rows.join(F.broadcast(limit), F.col("lang_pred") == F.col("_lang"), "left")  # one row a language
    return found.select("doc_id", "trained", "lang_pred", "entropy", score.alias("score"), (F.col("entropy").isNull() | F.coalesce(F.col("entropy") > F.col("_max"), F.lit(False))).alias("rejected"))
