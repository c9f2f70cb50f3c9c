"""Archives: round trips, and damage of every kind against what is left intact."""

import base64
import hashlib
import random
import time

import pyarrow as pa
import pytest

from meridian.llm import warc

PAGES = "page_id long, url string, html string, path string, kind string, digest string, last long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 5) for r in rows], PAGES)


def brute(rows):
    rows = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, p in rows:
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    out = []
    for i, p in rows:
        first = i == last[p] or last[p] < 0
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else last[p]))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3\r\nEvil: yes é", "<p>one</p>"), (4, None, None), (5, "http://a/5", ""), (6, "", "x" * 3_000_000)]
ROWS += [(7, "u", "é\x00\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n😀"), (7, "u", "é\x00\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n😀"), (None, "u", "<p>one</p>"), (None, "u", "of none"), (-3, "u", "negative")]


@pytest.mark.parametrize("limit", [warc.BROADCAST_DIGESTS, 0])
def test_round_trip_of_hard_pages(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    rows = ROWS + [(100 + i, "hot", "the same page") for i in range(20)]
    assert sorted(map(tuple, warc.round_trip(pages_of(spark, rows).repartition(3)).collect()), key=repr) == brute(rows)


def test_short_payloads_are_responses_all(spark):
    got = warc.round_trip(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), 3).collect()
    assert {(r["page_id"], r["refers_to"]) for r in got} == {(1, None), (2, None), (3, 4), (4, None)}


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, [])).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_payloads_urls_and_files(spark, tmp_path, compress):
    folder = f"file://{tmp_path}"
    files = warc.write_archives(pages_of(spark, ROWS).repartition(1), folder, compress=compress, file_bytes=2000)
    assert files.count() > 1
    back = warc.read_archives(files, folder).filter("kind = 'record'").collect()
    texts = {bytes(r["payload"]) for r in back if r["type"] == "response"}
    assert texts == {(h or "").encode() for _, _, h in ROWS}
    assert {r["uri"] for r in back} >= {"http://a/3%0D%0AEvil:%20yes%20%C3%A9", "http://a/1", ""} and "evil" not in str([r["record_id"] for r in back])


def archive(n=40, compress=True, seed=1):
    rng = random.Random(seed)
    parts = []
    for i in range(n):
        text = "".join(rng.choice("abcdefgh <>\n") for _ in range(rng.choice([0, 10, 300, 5000])))
        parts.append((warc.gzipped if compress else bytes)(warc.page_record(i, f"http://site/{i}", text.encode(), None if i % 5 else i + 1)))
    return parts


def read(data):
    rows = list(warc.salvaged(pa.BufferReader(data)))
    at = 0
    for r in rows:  # records and gaps cover the file
        assert r["at"] == at and r["bytes"] > 0
        at += r["bytes"]
    assert at == len(data)
    return [int(r["record_id"].split(":")[-1]) for r in rows if r["kind"] == "record"], [(r["at"], r["bytes"]) for r in rows if r["kind"] == "gap"]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_every_record_without_damage_is_recovered(compress, seed):
    rng, parts = random.Random(seed), archive(compress=compress, seed=seed)
    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    data, hurt = bytearray(b"".join(parts)), set()
    for _ in range(rng.randrange(1, 6)):
        lo = rng.randrange(len(data))
        hi = min(len(data), lo + rng.choice([1, 2, 30, 900]))
        for i in range(lo, hi):
            data[i] ^= rng.randrange(1, 256)
        hurt |= {i for i, e in enumerate(ends) if e > lo and e - len(parts[i]) < hi}
    rows = list(warc.salvaged(pa.BufferReader(bytes(data))))
    got = {r["at"]: r["record_id"] for r in rows if r["kind"] == "record"}
    starts = {e - len(p): i for i, (e, p) in enumerate(zip(ends, parts))}
    # headers (of gzip, of records) are covered by no sum: a record that is hurt there may still be read
    assert set(got) <= set(starts) and all(got.get(at) == f"urn:page:{i}" for at, i in starts.items() if i not in hurt)
    assert sum(r["bytes"] for r in rows if r["kind"] == "gap") == sum(len(parts[i]) for at, i in starts.items() if at not in got)


@pytest.mark.parametrize("compress", [True, False])
def test_cut_inserted_and_missing_bytes(compress):
    parts = archive(compress=compress)
    whole = b"".join(parts)
    assert read(whole) == (list(range(40)), []) and read(b"") == ([], []) and read(b"junk") == ([], [(0, 4)])
    cut = whole[: -len(parts[-1]) // 2 - 1]
    assert read(cut) == (list(range(39)), [(len(whole) - len(parts[-1]), len(cut) - len(whole) + len(parts[-1]))])
    junk = b"\x1f\x8b\x08\x00WARC/1.1\r\njunk\x1f\x8b"
    at = sum(map(len, parts[:10]))
    assert read(whole[:at] + junk + whole[at:]) == (list(range(40)), [(at, len(junk))])
    assert read(junk + whole) == (list(range(40)), [(0, len(junk))]) and read(whole + junk) == (list(range(40)), [(len(whole), len(junk))])
    got, gaps = read(whole[: at + 20] + whole[at + 25 :])
    assert got == [i for i in range(40) if i != 10] and gaps == [(at, len(parts[10]) - 5)]


def test_lengths_and_digests_that_lie():
    good = warc.page_record(1, "u", b"text", None)
    for bad in (good.replace(b"text", b"test"), good.replace(b"Length: 4", b"Length: 5"), good.replace(b"WARC-Type", b"Other"), good[:-1] + b"x"):
        one = warc.page_record(2, "u", b"other", None)
        assert read(bad + one) == ([2], [(0, len(bad))]) and read(warc.gzipped(bad) + warc.gzipped(one))[0] == [2]
    far = good.replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTTP", 1)
    far = far[: far.index(b"Content-Length", far.index(b"Block-Digest"))] + b"Content-Length: 999999999999999\r\n\r\n" + far[far.index(b"HTTP/1.1") :]
    assert read(far + good)[0] == [1]


def test_mixed_archives_and_folded_headers():
    plain = warc.page_record(3, "u", b"three", None).replace(b"WARC-Date: ", b"X-More: a\r\n b\r\nWARC-Date: ")
    assert read(warc.gzipped(warc.page_record(1, "u", b"one", None)) + plain + warc.gzipped(warc.page_record(2, "u", b"two", None))) == ([1, 3, 2], [])


def test_members_larger_than_a_read_and_false_starts_take_linear_time():
    big = warc.page_record(1, "u", random.Random(1).randbytes(5 << 20), None)
    for pack in (warc.gzipped, bytes):
        data = bytearray(pack(big) + pack(big))
        data[1 << 20] ^= 1
        began = time.time()
        assert read(bytes(data) + b"\x1f\x8b\x08" * 100_000 + pack(big))[0] == [1, 1]
        assert time.time() - began < 30
