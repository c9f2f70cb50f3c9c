"""Sorted-string-table shards of token ids, with binary-search lookup.

A shard holds documents in ascending key order. Blocks of some 64 KiB hold entries (shared prefix, key suffix,
ids); then follow a sparse index (last key and offset of each block), a Bloom filter of the keys and a footer. Keys
are 8 bytes that sort as the ids do. A file is written under a name of its own by each attempt of a task; the
manifest, a written table, lists the files of the attempts that counted. Repeated keys stand side by side.

Null and empty texts are documents of the end id alone. A row without an id has no key and is left out. An empty table
gives no shards and no rows. Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import new_path, written
from .wordtokens import encoder, open_fs

BLOCK, BITS_PER_KEY, PROBES = 1 << 16, 10, 7
MAGIC = b"MSSTABL1"
FOOTER = struct.Struct("<QQQQQB7x8s")  # index, filter, end, entries, ids, bytes an id
#: Characters of text that a shard takes about.
SHARD_CHARS = 64 << 20


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([zlib.crc32(k) | zlib.crc32(k[::-1], 0x5EED) << 32 for k in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.block, self.last, self.index, self.keys, self.at, self.ids = out, width, bytearray(), b"", [], [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        shared = shared if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self.out.write(self.block)
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> int:
        self._flush()
        index = b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        field = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 100_000):
            field[_probes(self.keys[i : i + 100_000], bits).ravel().astype(np.int64)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(field).tobytes()
        footer = FOOTER.pack(self.at, self.at + len(index), self.at + len(index) + len(bloom), len(self.keys), self.ids, self.width, MAGIC)
        self.out.write(index + bloom + footer)
        self.out.close()
        return self.at + len(index) + len(bloom) + len(footer)


class Reader:
    """A shard: entries in order, or one document by key."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.index_at, self.bloom_at, end, self.entries, self.ids, self.width, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or end + FOOTER.size != size:
            raise ValueError("not a whole shard")
        raw = file.read_at(self.bloom_at - self.index_at, self.index_at)
        self.index = [(raw[i : i + 8], *struct.unpack_from("<QQ", raw, i + 8)) for i in range(0, len(raw), 24)]
        self.bloom = None

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"

    def _block(self, i: int):
        _, at, n = self.index[i]
        data, key, p = self.file.read_at(n, at), b"", 0
        while p < n:
            shared, p = _read_varint(data, p)
            own, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key, p = key[:shared] + data[p : p + own], p + own
            yield key, data[p : p + size]
            p += size

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes):
        """The ids of the first document with this key, or None: filter, then binary search, then one block."""
        if self.bloom is None:
            raw = self.file.read_at(self.file.size() - FOOTER.size - self.bloom_at, self.bloom_at)
            self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], np.frombuffer(raw, np.uint8, offset=8)
        p = _probes([key], self.bits)[0].astype(np.int64)
        if not (self.bloom[p >> 3] >> (7 - (p & 7)) & 1).all():
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        if lo == len(self.index):
            return None
        return next((np.frombuffer(v, self.dtype) for k, v in self._block(lo) if k == key), None)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) and returns the manifest: path, first, entries, ids, bytes of each shard."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a fixed 1.7 MB
    d = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    if shards is None:
        chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(chars // SHARD_CHARS + 1, 2 * spark.sparkContext.defaultParallelism)
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def run(batches):
        enc = encoder(spec.value, True)
        system, base = open_fs(folder)
        end = np.array([end_id], enc.dtype).tobytes()
        out = None
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if out is None:
                    first, path = doc, f"{base}/{uuid.uuid4().hex}.sst"
                    out = Writer(system.open_output_stream(path), np.dtype(enc.dtype).itemsize)
                out.add(key_of(doc), enc(text or "") + end)
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pylist([{"path": path.rsplit("/", 1)[1], "first": first, "entries": len(out.keys), "ids": out.ids, "bytes": size}])

    sorted_docs = d.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    return written(sorted_docs.mapInArrow(run, "path string, first long, entries long, ids long, bytes long"), "shards")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    before = Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # a row a shard
    based = based.select("path", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "path")

    def run(batches):
        system, base = open_fs(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{base}/{path}") as file:
                    rows = []
                    for key, value in (shard := Reader(file)):
                        ids = np.frombuffer(value, shard.dtype)
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    folder = new_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, vocabulary, folder, end_id), folder)
