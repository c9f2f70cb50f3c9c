"""Quality rules: fences per language and source from mergeable quantile sketches, then a joined filter.

Every document gets a few counts. KLL sketches of the ratios are built per (lang, source) from texts that pass the base
rules, and merged to the language and to the whole corpus. A group's quantile is the mean of its own, its language's
and the corpus's, weighted by how many texts each has against PRIOR texts of the level above, so small groups lean on
larger ones without a switch. The fence of a ratio lies SPREADS times the distance between two quantiles away from the
median, for the mean length of words on both sides; nothing else is fixed. A text is rejected when it lies beyond its group's fence by more than chance:
of a count k, k - CHANCE * sqrt(k) is held against the fence. Sketched ratios are (k + 1) / (n + 1), so that a group without
any symbol has a fence that reflects how long its texts are.

Null text has no words. Null lang or source form groups of their own. Repeated rows are judged alike; the verdict on a
text doesn't depend on doc_id. An empty table gives an empty result. Columns other than those named are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

SYMBOLS = "#*$%&|<>"
#: ratio: near and tail quantile, spread. Symbols are bounded near the middle, as junk may be a good part of a group.
SPREADS = {"symbol_ratio": (0.5, 0.75, 6.0), "dup_line_ratio": (0.5, 0.98, 3.0), "repeat_ratio": (0.5, 0.98, 3.0), "mean_word": (0.25, 0.75, 6.0)}
PRIOR, CHANCE = 100.0, 3.0
BASE_WORDS, BASE_REPEAT = 50, 50


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are 64-bit hashes; sorting (hash, place) puts equal ones side by side, so a text costs n log n.
    """
    def at(i):
        return F.get(words, i)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))
    return F.array_sort(hashes)


def _starts(pairs: Column) -> Column:
    def same(x, j):
        return F.get(pairs, j)["h"] == x["h"]
    return F.array_sort(F.transform(F.filter(pairs, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    out = out.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    out = out.withColumn("_n", F.size("_w"))
    out = out.withColumn("_p", _repeat_words(F.col("_w"), F.col("_n")))
    out = out.withColumn("_s", _starts(F.col("_p")))
    solid = F.translate(t, SPACES, "")
    s = F.col("_s")
    covered = F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    return out.select(
        *[c for c in docs.columns if c != text],
        F.col("_n").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


_COUNTS = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}


def ratios() -> dict[str, Column]:
    """What is sketched."""
    out = {k: (F.col(c) + 1) / (F.col(n) + 1) for k, (c, n) in _COUNTS.items()}
    return out | {"mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))}


def certain() -> dict[str, Column]:
    """What is held against the upper fences."""
    out = {k: (F.col(c) - CHANCE * F.sqrt(F.col(c))) / F.greatest(F.col(n), F.lit(1)) for k, (c, n) in _COUNTS.items()}
    return out | {"mean_word": ratios()["mean_word"]}


def fences(measured: DataFrame, prior: float = PRIOR) -> DataFrame:
    """_lang, _source, max_ of each ratio and min_mean_word: one row per group that has a text that passes the base rules.

    Each task sends one sketch per group at most, so a hot source costs no more than a rare one.
    """
    r = ratios()
    base = measured.filter(~base_failed()).select("lang", "source", *[c.alias(k) for k, c in r.items()])
    own = base.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k).alias(k) for k in r])
    own = written(own, "sketches")
    by_lang = own.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n_lang"), *[F.kll_merge_agg_double(k).alias(f"l_{k}") for k in r])
    wanted = [(k, p) for k, (near, tail, _) in SPREADS.items() for p in sorted({0.5, near, tail})]
    whole = own.groupBy().agg(*[F.kll_merge_agg_double(k).alias(k) for k in r]).select(*[F.kll_sketch_get_quantile_double(k, F.lit(p)).alias(f"{k}_{p}") for k, p in wanted])
    all_ = (whole.first() if not own.isEmpty() else None) or {f"{k}_{p}": None for k, p in wanted}  # one row
    own = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")

    def q(k, p):
        def of(sketch):
            return F.kll_sketch_get_quantile_double(sketch, F.lit(p))
        lang = (F.col("n_lang") * of(f"l_{k}") + prior * F.lit(all_[f"{k}_{p}"]).cast("double")) / (F.col("n_lang") + prior)
        return (F.col("n") * of(k) + prior * lang) / (F.col("n") + prior)

    far = {k: spread * (q(k, tail) - q(k, near)) for k, (near, tail, spread) in SPREADS.items()}
    return own.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[(q(k, 0.5) + x).alias(f"max_{k}") for k, x in far.items()], (q("mean_word", 0.5) - far["mean_word"]).alias("min_mean_word"))


def judge(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, text, lang, source)."""
    m = written(features(docs.select("doc_id", "text", "lang", "source")), "quality")
    j = m.join(fences(m, prior), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    good = F.coalesce(ratios()["mean_word"] >= F.col("min_mean_word"), F.lit(True))
    for k, c in certain().items():
        good = good & F.coalesce(c <= F.col(f"max_{k}"), F.lit(True))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"))
