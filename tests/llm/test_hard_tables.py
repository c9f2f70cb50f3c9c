"""Nulls in any column, empty and very long texts, ties, repeated rows and ids, empty tables, columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from meridian.llm import bpe, ctw, decontaminate, langid, mainhtml, neardup, quality, sstable, tokencounts, toxicity
from meridian.llm.queries import public_vocabulary

CLASHING = "row score _text _toxicity _w _n h n class sig block bucket rep words pos first key train".split()
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i % 37} and some{i % 11}" for i in range(60))
    rows = [(i, text + f" number {i} of them", "en" if i % 2 else "de", "s") for i in range(12)]
    rows += [(3, text + " number 3 of them", "en", "s")] * 2 + [(4, "another text under the same id", None, None), (4, None, "en", "s"), (None, text, None, None), (None, None, None, None)]
    rows += [(50, "", "en", None), (51, " \n\t ", None, "s"), (52, "long text, " * 40_000, "en", "t"), (53, "x" * 300_000, "de", "t"), (54, "\x00é😀 ", "xx", "u")]
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(3, 0, 0), (None, None, None), (5, None, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "another text under the same id"), (1, "another text under the same id"), (2, None), (None, "long text")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, labels, items: toxicity.scores(d, labels, F.lit(True)),
    "decontamination": lambda d, labels, items: decontaminate.contamination(d, items),
    "quality": lambda d, labels, items: quality.judge(d),
    "bpe": lambda d, labels, items: bpe.digests(d, public_vocabulary("byte_bpe_50k.json")),
    "langid": lambda d, labels, items: langid.identify(d, F.col("doc_id") % 3 != 1),
    "neardup": lambda d, labels, items: neardup.near_duplicates(d),
    "ctw": lambda d, labels, items: ctw.scores(d, F.col("doc_id") % 7 != 2),
    "tokencounts": lambda d, labels, items: tokencounts.counted(d, public_vocabulary("word_bpe_49k.json")),
    "sstable": lambda d, labels, items: sstable.round_trip(d, public_vocabulary("word_bpe_49k.json")),
    "mainhtml": lambda d, labels, items: mainhtml.extract(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "score", "row")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_for_each_row(docs, labels, items, name):
    rows = OPERATORS[name](docs, labels, items).collect()
    assert len(rows) == (docs.filter("doc_id is not null").count() if name == "sstable" else docs.count())
    same = [tuple(r)[1:] for r in rows if r[0] == 3 and name != "sstable"]
    assert len(set(same)) <= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(docs, labels, items, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_empty_side_tables(docs, labels, items, name):
    rows = OPERATORS[name](docs, labels.limit(0), items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(getattr(r, "contaminated", False) or getattr(r, "score", 0) > 0.5 for r in rows)


def test_different_texts_under_one_id_are_compared_each_for_itself(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, one), (None, one)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == [(None, None), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_pipeline_on_a_hard_table(spark, docs, labels, items, tmp_path):
    import corpus_pipeline

    for name, df in (("documents", docs), ("labels", labels.limit(0)), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == 4 or after.columns == docs.columns
        d = after
        sizes.append(d.count())
    assert sizes[0] == docs.count() and sizes[1] >= sizes[2] >= sizes[3] == sizes[4] and sizes[2] < sizes[1]
    assert len({r.doc_id for r in d.collect()}) == sizes[4]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
