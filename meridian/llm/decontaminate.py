"""Benchmark decontamination as a prefix-filtered containment join.

A window is `size` consecutive words of an item (or the whole of a shorter item). Its tokens are shingles of up
to `SHINGLE` words. A first scan of the documents counts those shingles, which orders them by rarity. Containment is
exact, so the necessary prefix of a window is one token, the rarest, and a window with a token that no document has
is done. A second scan lets documents meet the prefix tokens only; from a token's place follows the window's, which
must lie within the document, and the words there must equal the window's words.

Null or empty texts have no words and no hits; an empty benchmark or documents table gives no hits or no rows. There is
one result for each row of documents, so rows that repeat an id are each judged by their own text; repeated items
count once. A very long text is one row of a task. Columns other than the named ones are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower, written

SIZE, SHINGLE = 10, 5
#: Distinct benchmark shingles up to which they are broadcast (some 40 bytes each); beyond, joins shuffle places and hashes.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _hashes(ws: Column, n: Column, k: int) -> Column:
    """The hashes of the shingles of k words of ws, which has n >= k words."""
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, win (array of words), k (shingle length), one row per window."""
    w = items.select("item_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))
    w = w.select("item_id", "_w", F.explode(starts).alias("_i")).select("item_id", F.slice("_w", F.col("_i") + 1, size).alias("win"))
    return w.withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))


def _shingles(w: DataFrame, ks: list[int]) -> DataFrame:
    """w with off and h: every shingle of every window."""
    arr = F.array().cast("array<bigint>")
    for k in ks:
        arr = F.when(F.col("k") == k, _hashes(F.col("win"), F.size("win"), k)).otherwise(arr)
    return w.select("*", F.posexplode(arr).alias("off", "h"))


def _document_shingles(ws: Column, n: Column, ks: list[int]) -> Column:
    empty = F.array().cast("array<bigint>")
    parts = [F.when(n >= k, _hashes(ws, n, k)).otherwise(empty) for k in ks]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _place(i: Column, n: Column, ks: list[int]) -> Column:
    """The place of shingle i of _document_shingles."""
    place, before = i, F.lit(0)
    for a in ks[:-1]:
        before = before + F.greatest(n - a + 1, F.lit(0))
        place = F.when(i >= before, i - before).otherwise(place)
    return place


def _around(at: Column, size: int) -> list[Column]:
    """Where the words around a place begin, and the words: a window that holds it starts at most size - 1 words before."""
    lo = F.greatest(at - size + 1, F.lit(0))
    return [lo.alias("lo"), F.slice("_w", lo + 1, 2 * size - 1 + SHINGLE).alias("around")]


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast: int = BROADCAST_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of each row of docs, and (row, start, len, item_id) of each occurrence of a window."""
    win = written(windows(items, size).distinct(), "windows")
    ks = sorted(r.k for r in win.select("k").distinct().collect()) or [SHINGLE]  # SHINGLE values at most
    shingles = written(_shingles(win, ks), "window-shingles")
    known = shingles.select("h").distinct()
    few = known.count() <= broadcast
    d = docs.select("doc_id", words(F.col("text")).alias("_w")).withColumn("_n", F.size("_w"))
    hashes = _document_shingles(F.col("_w"), F.col("_n"), ks)
    every = d.select(F.explode(hashes).alias("h"))
    freq = F.count(F.lit(1)).alias("freq")
    rarity = every.join(F.broadcast(known), "h").groupBy("h").agg(freq) if few else every.groupBy("h").agg(freq).join(known, "h")
    first = Window.partitionBy("item_id", "win").orderBy(F.coalesce("freq", F.lit(0)), "off")
    prefix = shingles.join(written(rarity, "rarity"), "h", "left").withColumn("_r", F.row_number().over(first)).filter("_r = 1 and freq is not null")
    prefix = written(prefix.select("item_id", "win", "off", F.col("h").alias("ph")), "prefixes")
    needed = prefix.select(F.col("ph").alias("h")).distinct()
    d = d.withColumn("row", F.monotonically_increasing_id())
    if few:
        e = d.select("row", "doc_id", "_w", "_n", F.posexplode_outer(hashes).alias("_p", "_s"))
        e = e.join(F.broadcast(needed.withColumn("known", F.lit(True))), F.col("_s") == F.col("h"), "left").filter(F.col("known") | F.col("_p").isNull() | (F.col("_p") == 0))
        at = _place(F.coalesce("_p", F.lit(0)), F.col("_n"), ks)
        e = e.select("row", "doc_id", F.col("_n").alias("n_words"), (F.coalesce("_p", F.lit(0)) == 0).alias("first"), at.alias("pos"), "h", *_around(at, size))
        met = written(e.withColumn("around", F.when(F.col("h").isNotNull(), F.col("around"))), "document-shingles")
        counted = met.filter("first").select("row", "doc_id", "n_words")
    else:
        d = written(d, "document-words")
        counted = d.select("row", "doc_id", F.col("_n").alias("n_words"))
        e = d.select("row", "_n", F.posexplode(hashes).alias("_p", "h")).select("row", _place(F.col("_p"), F.col("_n"), ks).alias("pos"), "h").join(needed, "h")
        places = e.groupBy("row").agg(F.collect_list(F.struct("pos", "h")).alias("_places"))  # no more than the text has words
        e = d.join(places, "row").select("row", F.col("_n").alias("n_words"), "_w", F.inline("_places"))
        met = e.select("row", "n_words", "pos", "h", *_around(F.col("pos"), size))
    start = F.col("pos") - F.col("off")
    found = met.filter("h is not null").join(prefix, F.col("h") == F.col("ph")).filter((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    found = found.filter(F.slice("around", start - F.col("lo") + 1, F.size("win")) == F.col("win"))
    return counted, written(found.select("row", start.alias("start"), F.size("win").alias("len"), "item_id"), "hits")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    counted, found = hits(docs, items, size, broadcast)
    spans = found.groupBy("row", "start").agg((F.col("start") + F.max("len")).alias("end"))
    seen = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(seen, F.lit(0))), F.lit(0)))
    per = spans.groupBy("row").agg(F.sum("_new").alias("n_hit"))
    who = found.select("row", F.col("item_id").cast("string").alias("item")).distinct()
    who = who.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    out = counted.join(per, "row", "left").join(who, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n_words").cast("long"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
