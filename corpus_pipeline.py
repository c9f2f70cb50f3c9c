"""A corpus from documents: toxic texts out, quality rules, near duplicates, benchmark leaks, then tokens.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns
of documents, extra ones included; every decision removes whole rows, and clean documents pass. Rows are told apart by
numbers of their own, so nulls and repeats among doc_id do no harm, and columns of any name are carried along.
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, decontaminate, neardup, quality, toxicity
from meridian.llm.common import fold, new_path, table, written
from meridian.llm.queries import public_vocabulary


def _numbered(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, row): a number that is the row's alone, and the row as a struct."""
    return written(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "numbered")


def _keep(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("doc_id"), "doc_id", "left_semi").select("row.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5. Texts without letters, empty and null ones pass unless the labels say otherwise."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0).filter("score < 0.5").select("row.*")


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep: none of fewer than 50 words, so no empty or null text."""
    rows = _numbered(docs)
    return _keep(rows, quality.judge(rows.select("doc_id", "row.text", "row.lang", "row.source")).filter("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, of several the first. Texts without words stay."""
    rows = _numbered(docs)
    found = neardup.near_duplicates(rows.select("doc_id", "row.text")).select(F.col("doc_id").alias("n"), "component_id")
    named = found.join(rows.select(F.col("doc_id").alias("n"), F.col("row.doc_id").alias("id")), "n")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first"))
    return _keep(rows, first.select(F.col("first.n").alias("doc_id")))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item."""
    rows = _numbered(docs)
    return _keep(rows, decontaminate.contamination(rows.select("doc_id", "row.text"), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.digests(docs, public_vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", with_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("bpe", tokens),
]
#: SQL can express neither the models of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
