"""Whole Arrow batches of text as byte arrays: words, word hashes and shingle hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out as one array at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Runs of bytes other than ASCII white space, A-Z lower-cased: start, end, hash and row of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.bytes = buf = _LOWER[buf]
        self.rows, n = len(offs) - 1, len(buf)
        if not n:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            self.hash, self.count = np.zeros(0, np.uint64), np.zeros(self.rows, np.int64)
            return
        solid = ~_IS_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offs[1:], self.start, "right")
        self.count = np.bincount(self.row, minlength=self.rows)
        up, down = _power(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each run of k words; a row of fewer words, but not none, has one shingle of them all."""
        h, n = self.hash, len(self.hash)
        if not n:
            return h, self.row
        acc = np.zeros(n, np.uint64)
        left = np.cumsum(self.count)[self.row] - np.arange(n)  # words from here to the row's end
        for j in range(min(k, n)):
            acc[: n - j] += np.where(left[: n - j] > j, h[j:] * _PLACE[j], np.uint64(0))
        begins = np.zeros(n, bool)
        begins[(np.cumsum(self.count) - self.count)[self.count > 0]] = True
        keep = (left >= k) | begins
        span = np.minimum(left, k).astype(np.uint64)
        return mix(acc[keep] + span[keep] * _PLACE[15]), self.row[keep]
