"""Reading and writing of catalogue files: tables, forced-photometry text, statistics, and which files are new."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
#: Folders that small files are dealt to.
FOLDERS = 64


def scan_table(spark: SparkSession, *paths: str) -> DataFrame:
    """One table out of Parquet folders of the same schema, hive partitions included."""
    return spark.read.option("mergeSchema", "false").parquet(*paths)


def scan_text_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Space-delimited text with # comments and a header line."""
    return spark.read.csv(path, sep=" ", comment="#", header=True, schema=schema)


def parse_fp(files: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of whole forced-photometry files (path, value): path, ra, dec, then columns (name: type).

    A file has # lines with its position, one comma-separated line of names, and after it rows by white space, whose
    fields may have commas; null is NULL, and so is a column that the file lacks. A file without rows gives none.
    """
    def number(label: str) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract(value, '{label}\\\\s*=\\\\s*{NUMBER}', 1), '') as double)")
    lines = F.filter(F.transform(F.split("value", "\\r?\\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    f = files.select("path", number("R[.]A[.]").alias("ra"), number("Dec[.]").alias("dec"), lines.alias("l"))
    f = f.withColumn("head", F.get(F.filter("l", lambda x: x.contains(",")), F.lit(0)))
    names = F.transform(F.split("head", ","), lambda x: F.trim(x))
    rows = F.slice("l", F.array_position("l", F.col("head")).cast("int") + 1, F.size("l"))
    f = f.select("path", "ra", "dec", names.alias("names"), F.explode(rows).alias("row"))
    f = f.select("path", "ra", "dec", "names", F.split("row", "\\s+").alias("v"))
    def field(name: str, kind: str) -> Column:
        at = F.array_position("names", name)
        text = F.when(at > 0, F.try_element_at("v", at.cast("int")))
        return F.nullif(text, F.lit("null")).try_cast(kind).alias(name)
    return f.select("path", "ra", "dec", *[field(n, k) for n, k in columns.items()])


def scan_fp_text(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_fp(files, columns)


def fp_index(spark: SparkSession, folder: str) -> DataFrame:
    """path, ra, dec of each forced-photometry file."""
    return scan_fp_text(spark, folder, {}).distinct()


def sink_table(df: DataFrame, path: str, by: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned, with ids as nullable longs and binary columns as text."""
    kinds = dict(df.dtypes)
    cast = {c: F.col(c).cast("long") for c in ids} | {c: F.col(c).cast("string") for c, k in kinds.items() if k == "binary"}
    df.withColumns(cast).write.partitionBy(*by).parquet(path)


def sink_texts(df: DataFrame, folder: str, key: str, order: str, value: str = "value", folders: int = FOLDERS) -> int:
    """Writes the lines (value) of each key, in order, as one file part=N/key=KEY.txt under the folder; returns how many.

    Keys are hashed into a fixed number of folders, so what is listed and committed doesn't grow with a folder a file, and
    each of them is written by one task. A file is moved to its name when it is whole, so a repeated task replaces it.
    """
    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        name = out = draft = None
        made = set()

        def finish():
            out.close()
            system.move(draft, name)
            return pa.RecordBatch.from_pydict({"name": [name]})
        for batch in batches:
            for part, k, line in zip(*(batch.column(c).to_pylist() for c in ("_part", "_key", "_line"))):
                target = f"{base}/part={part}/{key}={k}.txt"
                if target != name:
                    if out is not None:
                        yield finish()
                    if part not in made:
                        system.create_dir(f"{base}/part={part}", recursive=True)
                        made.add(part)
                    name, draft = target, f"{base}/part={part}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                out.write(line.encode() + b"\n")
        if out is not None:
            yield finish()

    lines = df.select(F.pmod(F.xxhash64(key), F.lit(folders)).alias("_part"), F.col(key).cast("string").alias("_key"), F.col(order).alias("_order"), F.coalesce(value, F.lit("")).alias("_line"))
    return lines.repartition(folders, "_part").sortWithinPartitions("_part", "_key", "_order").select("_part", "_key", "_line").mapInArrow(run, "name string").count()


def sink_stats_csv(df: DataFrame, path: str) -> None:
    df.na.fill("").write.csv(path, header=True)


def sink_json(df: DataFrame, path: str) -> None:
    """JSON lines, null fields kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def there(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def deleted(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def convert(spark: SparkSession, paths: dict[str, str], schema: str) -> None:
    """Text tables to Parquet, source folder by target folder; finished targets (with a _SUCCESS file) are left alone."""
    for source, target in paths.items():
        if not there(spark, f"{target}/_SUCCESS"):
            scan_text_table(spark, source, schema).write.mode("overwrite").parquet(target)


def unseen(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files whose key the table of finished ones lacks."""
    return files.join(done.select(key), key, "left_anti")
