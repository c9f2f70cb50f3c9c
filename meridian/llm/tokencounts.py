"""Token counts per document of flat, unindexed token files, by a scan for end-of-document ids.

Blocks of a file are read apart. A vectorised search gives the separators of a block; the tokens before its first
and after its last one belong to documents that other blocks hold the rest of. A prefix scan over the blocks of a file
gives each block the number of documents and the tokens carried into it, and so stitches the boundaries. The scan is
over one small row a block; the lengths that a block has are joined to what it is carried.

A file may end without a separator: the rest is a document. Empty files and tables give no rows. A document of
no tokens, as null and empty texts are, counts 0; null ids are kept. A very long text is written and read in blocks as
any other. Repeated rows are counted each. Columns other than doc_id and text are left alone. Token files hold unsigned little-endian ids of `width` bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import new_path, written
from .wordtokens import encoder, open_fs

BLOCK_TOKENS = 4 << 20


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_token: str = "<|endoftext|>") -> tuple[DataFrame, int]:
    """Writes docs (doc_id, text) as flat files; gives (path, bytes, doc_ids in file order) and the separator's id.

    Separators inside a text are encoded as ordinary text.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec, end_id = spark.sparkContext.broadcast(text), Tokenizer.from_str(text).token_to_id(end_token)
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def run(batches):
        enc = encoder(spec.value, False)
        system, base = open_fs(folder)
        end, name, out, size, at = np.array([end_id], enc.dtype).tobytes(), f"{uuid.uuid4().hex}.bin", None, 0, 0
        for batch in batches:
            if len(batch) and out is None:
                out = system.open_output_stream(f"{base}/{name}")
            for t in batch.column("text").to_pylist():
                size += out.write(data := enc(t or "") + end) or len(data)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), pa.array(np.arange(at, at + len(batch))), batch.column("doc_id")], ["path", "ordinal", "doc_id"])
            at += len(batch)
        if out is not None:
            out.close()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "path string, ordinal long, doc_id long"), "token-files"), end_id


def document_lengths(files: DataFrame, folder: str, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, n_tokens of every document in files (path)."""
    step = block_tokens * width

    def sizes(batches):
        system, base = open_fs(folder)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([system.get_file_info(f"{base}/{p}").size for p in paths], pa.int64())], ["path", "bytes"])

    def scan(batches):
        system, base = open_fs(folder)
        for batch in batches:
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "bytes"))):
                with system.open_input_file(f"{base}/{path}") as file:
                    ids = np.frombuffer(file.read_at(min(step, size - at), at), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                lens = np.diff(np.r_[-1, ends]) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([len(ends)]), pa.array([tail]), pa.array([at + len(ids) * width >= size]), pa.array([lens.tolist()], pa.list_(pa.int64()))], ["path", "at", "ends", "tail", "final", "lens"])

    blocks = files.select("path").distinct().mapInArrow(sizes, "path string, bytes long").filter("bytes > 0")
    blocks = blocks.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("at"))
    blocks = blocks.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path", "at")
    found = written(blocks.mapInArrow(scan, "path string, at long, ends long, tail long, final boolean, lens array<bigint>"), "token-blocks")
    order = Window.partitionBy("path").orderBy("at")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("path", "at", "ends", "tail")
    small = small.withColumn("base", F.coalesce(F.sum("ends").over(prior), F.lit(0))).withColumn("sum_tail", F.coalesce(F.sum("tail").over(prior), F.lit(0)))
    # tokens since the last separator: tails summed, less what was summed before the last block with a separator
    small = small.withColumn("cut", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("sum_tail"))).over(prior), F.lit(0)))
    found = found.join(small.select("path", "at", "base", (F.col("sum_tail") - F.col("cut")).alias("carry")), ["path", "at"])
    whole = F.when(F.col("ends") > 0, F.transform("lens", lambda n, i: n + F.when(i == 0, F.col("carry")).otherwise(0)))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    whole = F.concat(F.coalesce(whole, F.array().cast("array<bigint>")), F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return found.select("path", "base", F.posexplode(whole).alias("i", "n_tokens")).select("path", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens of each row of docs, through flat token files."""
    folder = new_path(docs.sparkSession, "tokens")
    names, end_id = write_tokens(docs, vocabulary, folder)
    return names.hint("merge").join(document_lengths(names, folder, end_id).hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")
