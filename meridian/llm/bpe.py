"""Byte-level BPE encoding and decoding from a public tokenizer file.

A piece of text is a doubly linked list of symbols; a heap holds the ranks of adjacent pairs. The lowest rank is
merged, entries whose symbols have changed since are skipped, and decoding concatenates vocabulary strings. Each
Python worker remembers pieces it has met, in a bounded memory.

The vocabulary file is read once where the job starts and broadcast: its size is fixed (some 1.5 MB).
Null and empty texts give no tokens, null ids are kept. Texts of any length cost n log n. Repeated rows are encoded
alike, an empty table gives an empty result, columns other than the id and the text are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern of byte-level BPE, and its form for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pieces of text that a worker remembers (some 250 bytes each).
MEMORY = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Memory(dict):
    """Results of make by key; emptied when it holds `size` of them."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        got = self[key] = self.make(key)
        return got


class ByteBPE:
    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        code = {ord(c): b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(code[ord(c)] for c in s)
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.byte_id = [vocab[c] for c in letters]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.ascii, self.any = re.compile(ASCII_PATTERN, re.ASCII), regex.compile(PATTERN)
        self.piece = Memory(lambda s: np.array(self.merge(s.encode()), "<u4").tobytes())

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        sym: list[int] = [self.byte_id[b] for b in data]
        n, ranks = len(sym), self.ranks
        if n < 2:
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, sym[i], sym[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # stale: one of the two has been merged
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((made, sym[k])):
                    heapq.heappush(heap, (r[0], i, made, sym[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], made))):
                heapq.heappush(heap, (r[0], h, sym[h], made, r[1]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str, special: bool = True) -> bytes:
        """Ids as little-endian 32-bit integers. special: the added tokens' strings in a text are those tokens."""
        parts = self.split_added.split(text) if special and self.split_added and any(t in text for t in self.added) else [text]
        out = []
        for part in parts:
            if special and part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                piece = self.piece
                out += [piece[s] for s in (self.ascii if part.isascii() else self.any).findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(spec: str) -> ByteBPE:
    return ByteBPE(spec)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids (binary, little-endian 32-bit), decoded (string) of each row."""
    return _run(docs, vocabulary, id_col, lambda ids, text: (ids, text), f"{id_col} long, ids binary, decoded string", [pa.binary(), pa.string()], ["ids", "decoded"])


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    def of(ids, text):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    return _run(docs, vocabulary, id_col, of, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs, vocabulary, id_col, of, schema, types, names):
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = tokenizer(spec.value)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows = [of(ids := bpe.encode(t or ""), bpe.decode(ids)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *[pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]], [id_col, *names])

    return docs.select(F.col(id_col).cast("long"), "text").mapInArrow(run, schema)
