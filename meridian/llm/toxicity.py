"""Toxicity of texts whose insults may be disguised.

A noisy channel is undone first: spans with digits or signs among letters, letters repeated three times or more, or
letters and signs set apart by spaces or dots, become a lattice of readings; the Viterbi path under a character trigram
model (trained on all documents) is the restored text. What sets letters apart may be nothing or a space between
words; a span is decoded whole, however long, at a cost in proportion to its length. Plain words have one reading. A logistic model over the words and word beginnings of restored text, found
and fitted on labelled rows, then scores the text. The character model tells Western European letters apart; letters
of other scripts are one code for it, and whole words of any script are features.

About `max_labelled` labelled ids are used to fit (those with the lowest hashes); the sample is broadcast, so texts are
never shuffled. The character counts cover every document. A label of a document counts once however often it is
repeated; a document labelled both ways counts for both.

Null and empty texts get the score of a text without any of the features. A corpus without labelled rows scores
0. Repeated rows get equal scores; very long texts are read whole; an empty table gives an empty result. Any columns may be carried along, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .alphabet import CODES, OTHER, SIZE, codes
from .bpe import Memory
from .common import written

MAX_LABELLED = 40_000
#: Labelled toxic rows that must hold a feature.
LEAST_ROWS = 3
#: The letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs in nats of the channel's errors.
SIGN, DROP, SPACED, APART, ORNAMENT = 1.0, 10.0, 0.5, 1.5, 1.0
_SIGN = "[" + re.escape("".join(SIGNS)) + "]"
_LETTER = r"[^\W\d_]"
#: Spans that may be disguised: letters and signs set apart, however many; signs between or before letters; a letter three times or more.
_UNIT = rf"(?:{_LETTER}|[013457@$€])"
SPACED_OUT = re.compile(rf"(?<![^\W_]){_UNIT}(?:[ .\-_*]{{1,3}}{_UNIT}(?![^\W_])){{2,}}")
SIGNED = re.compile(rf"(?<!\S)(?:[\"'(\[]?)((?:{_LETTER}|{_SIGN}|\*)*?(?:{_LETTER}{_SIGN}{{1,2}}|{_SIGN}{{1,2}}{_LETTER})(?:{_LETTER}|{_SIGN}|\*)*)")
ANY_SIGN = re.compile(_SIGN)
THRICE = re.compile(r"(.)\1\1")
WORD = re.compile(rf"{_LETTER}+")
ANY_LETTER = re.compile(_LETTER)
PREFIXES = range(3, 8)
#: Longest span whose restored text is remembered.
REMEMBERED = 200


def trigrams(docs: DataFrame) -> DataFrame:
    """(code, n) of character trigrams over all documents; code < 64 ** 3 by construction."""
    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 128):
                c = codes("\n\n".join(["", *(t for t in texts[i : i + 128] if t), ""])).astype(np.int32)
                total += np.bincount((c[:-2] << 12) + (c[1:-1] << 6) + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """-log P(c | a, b), interpolated with the lower orders by Witten-Bell weights; 64 x 64 x 64."""
    rows = counts.toPandas()  # 64 ** 3 rows at most
    n3 = np.zeros((SIZE,) * 3)
    n3.ravel()[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p = (n1 + 0.5) / (n1 + 0.5).sum()
    for n in (n2, n3):
        seen, total = (n > 0).sum(-1, keepdims=True), n.sum(-1, keepdims=True)
        lam = total / np.maximum(total + seen, 1)
        p = lam * n / np.maximum(total, 1) + (1 - lam) * p
    return -np.log(p).astype(np.float32)


def readings(span: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters its possible letters and their channel cost."""
    apart = SPACED_OUT.fullmatch(span) is not None
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", span, re.S)]
    out = []
    for c, n in runs:
        if c in SIGNS:
            each = [(x * min(n, 2), SIGN * n) for x in SIGNS[c]] + [("", DROP * n if n < 3 else ORNAMENT)]
            each += [(x, SIGN * n + 0.5) for x in SIGNS[c]] if n > 1 else []
        elif c.isalpha():
            each = [(c * n, 0.0)] if n < 3 else [(c, 0.5), (c * 2, 1.0)]
        elif apart:
            each = [("", SPACED * n), (" ", APART / n)]
        elif c == "*":
            each = [("", SPACED)]
        else:
            each = [(" ", 0.0)]
        out.append(each)
    return out


def restore(span: str, cost: np.ndarray) -> str:
    """The cheapest path through the lattice under the character model."""
    best: dict = {(0, 0): (0.0, None)}  # by the last two codes: the cost, and the path as (path before, letters)
    for each in [*readings(span.lower()), [(" ", 0.0)]]:
        step: dict = {}
        for (a, b), (total, path) in best.items():
            for letters, price in each:
                x, y, t = a, b, total + price
                for ch in letters:
                    z = CODES.get(ch, OTHER if ch.isalpha() else 0)
                    t += float(cost[x, y, z])
                    x, y = y, z
                if (x, y) not in step or t < step[x, y][0]:
                    step[x, y] = (t, (path, letters))
        best = step
    out, path = [], min(best.values(), key=lambda v: v[0])[1]
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out)).strip()


class _Spans(Memory):
    """Restored spans; long ones are not kept."""

    def __missing__(self, span):
        return self.make(span) if len(span) > REMEMBERED else super().__missing__(span)


class Restorer:
    def __init__(self, cost: np.ndarray):
        self.span = _Spans(lambda s: restore(s, cost), 100_000)

    def joined(self, text: str) -> str:
        """Lower-cased, with letters set apart restored: the one error that crosses white space."""
        return SPACED_OUT.sub(lambda m: self.span[m[0]] if ANY_LETTER.search(m[0]) else m[0], text.lower())

    def words(self, token: str) -> list[str]:
        """The restored words of what stands between white space."""
        if ANY_SIGN.search(token):
            token = SIGNED.sub(lambda m: m[0][: m.start(1) - m.start()] + self.span[m[1]], token)
        return [self.span[w] if THRICE.search(w) else w for w in WORD.findall(token)]


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def _known(restorer: Restorer, keep=None) -> Memory:
    """The features, of those in keep, of what stands between white space."""
    if keep is None:
        return Memory(lambda t: [f for w in restorer.words(t) for f in word_features(w)], 200_000)
    return Memory(lambda t: [keep[f] for w in restorer.words(t) for f in word_features(w) if f in keep] or None, 600_000)


def _document_features(texts, restorer, known) -> list[list]:
    """The distinct features of each text. All errors but spacing stay between white space, so tokens are remembered."""
    out = []
    for t in texts:
        found: set = set()
        for token in set(restorer.joined(t or "").split()):
            if fs := known[token]:
                found.update(fs)
        out.append(list(found))
    return out


def _counted(rows: DataFrame, cost, keep=None) -> DataFrame:
    """(feature, docs): in how many of rows a feature occurs."""
    def run(batches):
        restorer, n = Restorer(cost.value), Counter()
        known = _known(restorer, keep and keep.value)
        for batch in batches:
            for fs in _document_features(batch.column("text").to_pylist(), restorer, known):
                n.update(fs)
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(map(str, n))), pa.array(list(n.values()), pa.int64())], ["feature", "docs"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(map(str, n)), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "docs"])

    return rows.select("text").mapInArrow(run, "feature string, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))


def fit(labelled: DataFrame, cost) -> tuple[dict[str, int], np.ndarray, float]:
    """(features, weights, bias) from labelled rows (text, toxic)."""
    spark = labelled.sparkSession
    labelled = written(labelled, "labelled")
    size = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return {}, np.zeros(0), -30.0 if not bad else 30.0
    often = _counted(labelled.filter("toxic = 1"), cost).filter(F.col("docs") >= LEAST_ROWS).orderBy(F.desc("docs"), "feature")
    often = {r.feature: r.docs for r in often.collect()}  # of about max_labelled rows at most
    names = {f: i for i, f in enumerate(often)}
    order = list(often)
    clean = {order[int(r.feature)]: r.docs for r in _counted(labelled.filter("toxic = 0"), cost, spark.sparkContext.broadcast(names)).collect()}
    odds = {f: math.log((n + 0.5) / (bad + 1)) - math.log((clean.get(f, 0) + 0.5) / (good + 1)) for f, n in often.items()}
    keep = {f: i for i, f in enumerate(f for f in odds if odds[f] > 1.0)}
    held = spark.sparkContext.broadcast(keep)

    def run(batches):
        restorer = Restorer(cost.value)
        known = _known(restorer, held.value)
        for batch in batches:
            fs = _document_features(batch.column("text").to_pylist(), restorer, known)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(fs, pa.list_(pa.int32()))], ["toxic", "found"])

    seen = labelled.select("text", "toxic").mapInArrow(run, "toxic int, found array<int>")
    rows = seen.filter("size(found) > 0").collect()  # about max_labelled rows at most
    y = np.array([r.toxic for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])
    col = np.array([f for r in rows for f in r.found], int)
    rest = {0: good - int((y == 0).sum()), 1: bad - int((y == 1).sum())}  # rows without features
    w, b = np.zeros(len(keep)), math.log(bad / good)
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    total = bad + good
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(rows)) + b)))
        p0 = 1 / (1 + math.exp(-b))
        g = np.bincount(col, (p - y)[row], len(w)) + 1.0 * w
        gb = (p - y).sum() + p0 * (rest[0] + rest[1]) - rest[1]
        grad = np.r_[g, gb] / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return keep, w, float(b)


def labelled_rows(docs: DataFrame, labels: DataFrame, keep: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of about max_labelled labelled ids for which keep holds, chosen by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & keep).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 52)) < (max_labelled << 52) // n)
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def scored(docs: DataFrame, labels: DataFrame, keep: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every row of docs as a struct `row`, and its score. keep: which label rows (doc_id) may be learnt from."""
    spark = docs.sparkSession
    cost = spark.sparkContext.broadcast(character_model(trigrams(docs)))
    model = spark.sparkContext.broadcast(fit(labelled_rows(docs, labels, keep, max_labelled), cost))

    def run(batches):
        feats, w, b = model.value
        restorer = Restorer(cost.value)
        known = _known(restorer, feats)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                z = np.array([b + w[fs].sum() if fs else b for fs in _document_features(part.column("text").to_pylist(), restorer, known)])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, keep: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and score of every row of docs."""
    return scored(docs.select("doc_id", "text"), labels, keep, max_labelled).select("row.doc_id", "score")
