"""WARC archives: pages written as records, and a reader that salvages what damaged archives still hold.

The writer makes response records of pages and revisit records of their repeats, each a gzip member of its own, and
starts a new file after FILE_BYTES. A file is written under a name of its own by each attempt of a task; the manifest, a
written table, lists the files of the attempts that counted. The reader streams a file, a record at a time, compressed or
not. Each record is checked: gzip's sum, version line, headers, length, the two line ends after the block, block and
payload digests. Where a check fails it searches for the next member or version line whose record passes all of them,
goes on from there and returns the bytes between as a quarantined gap with the reason of the failure.

Of pages with equal payloads (bytes of the html in UTF-8; null: empty) that with the largest id is a response, the others
are revisits that refer to it; payloads under `revisit_bytes` are responses all. Rows under the same largest id are
responses all, and a null id counts as smaller than any. A page without a url has no target URI. Empty and very long
texts are records like any other; an empty table gives no file and no rows. Columns other than page_id, url and html are
left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, written
from .wordtokens import open_fs

FILE_BYTES, LEVEL = 128 << 20, 5
#: Bytes that the reader asks for at a time.
READ = 1 << 20
#: Repeated payloads whose digests are broadcast (some 100 bytes each); of more, those only that stand in over a 1/HOT_SHARE of the rows.
BROADCAST_DIGESTS = HOT_SHARE = 200_000
#: Longest version line and headers of a record that the reader accepts.
HEADER_BYTES = 1 << 20
#: Bytes within which a member must begin to give output.
GZIP_HEADER_BYTES = 1 << 10
DATE = "2000-01-01T00:00:00Z"  # pages carry no date of their own

MAGIC, VERSION, END = b"\x1f\x8b\x08", re.compile(rb"WARC/\d+\.\d+\r\n"), b"\r\n\r\n"
CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
START = re.compile(re.escape(MAGIC) + b"|" + VERSION.pattern)
COLUMNS = "path string, kind string, at long, bytes long, reason string, record_id string, type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def uri_of(url: str) -> str:
    """url with white space, control and other than ASCII characters escaped, so that it can't end its header line."""
    return urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))


def record(kind: str, record_id: str, uri: str | None, block: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | ({"WARC-Target-URI": uri_of(uri)} if uri is not None else {}) | more
    head |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def page_id_of(record_id: str | Column) -> Column:
    return F.expr(f"try_cast(nullif(substring_index({record_id}, ':', -1), '') as bigint)")


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    name = "urn:page:" + ("" if page_id is None else str(page_id))
    if refers_to is None:
        return record("response", name, url, http + payload, more)
    more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record("revisit", name, url, http, more)


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_responses(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to, the id of the page whose equal payload stands for this one's (null: its own does)."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.when(F.length("payload") >= revisit_bytes, F.unhex(F.sha2("payload", 256))))
    last = p.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    last = written(last, "repeats")
    count, rows = last.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= BROADCAST_DIGESTS:
        found = p.join(F.broadcast(last), "digest", "left")
    else:  # fewer than HOT_SHARE digests can stand in so many rows each; no other is a hot key
        hot = last.withColumn("hot", F.col("n") > rows / HOT_SHARE)
        marked = p.join(F.broadcast(hot.filter("hot")), "digest", "left")
        rest = marked.filter("hot is null").drop("last", "n", "hot").join(hot.filter("not hot").drop("hot").hint("merge"), "digest", "left")
        found = marked.filter("hot").drop("hot").unionByName(rest)
    return found.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) into folder; returns the manifest: path, records, bytes of each file."""
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)
    info = record("warcinfo", "urn:info", None, b"software: meridian\r\nformat: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"})

    def run(batches):
        pack = gzipped if compress else bytes
        system, base = open_fs(folder)
        out, size, n = None, 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    out = system.open_output_stream(f"{base}/{path}", compression=None)
                    size, n = out.write(pack(info)), 0
                size, n = size + out.write(pack(page_record(page_id, url, payload, refers_to))), n + 1
                if size >= file_bytes:
                    out = out.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    return written(with_responses(pages, revisit_bytes).mapInArrow(run, "path string, records long, bytes long"), "archives")


class Damaged(Exception):
    """A check failed; the reason."""


class Source:
    """A file as a window of bytes that moves on."""

    def __init__(self, file):
        self.file, self.at, self.held, self.end = file, 0, b"", False

    def byte_range(self, lo: int, n: int) -> bytes:
        """Up to n bytes from lo, which may lie before what was last asked for."""
        if not self.at <= lo <= self.at + len(self.held):
            self.file.seek(lo := min(lo, self.file.size()))
            self.at, self.held = lo, b""
        while len(self.held) < lo - self.at + n and (more := self.file.read(max(READ, lo - self.at + n - len(self.held)))):
            self.held = self.held[lo - self.at :] + more
            self.at = lo
        return self.held[lo - self.at : lo - self.at + n]

    def find(self, lo: int) -> int | None:
        """Where, from lo on, the next thing that looks like a member or a version line begins."""
        while True:
            last = len(self.byte_range(lo, 64)) < 64
            i = lo - self.at
            if hit := START.search(self.held, i):
                return self.at + hit.start()
            if last:
                return None
            lo = max(lo + 1, self.at + len(self.held) - 15)  # a version line or magic that the end of what is held cuts


class Plain:
    """The bytes of a record that isn't compressed."""

    def __init__(self, source: Source, at: int):
        self.source, self.at = source, at

    def read(self, n: int) -> bytes:
        out = self.source.byte_range(self.at, n)
        self.at += len(out)
        return out

    def finish(self) -> int:
        return self.at


class Member:
    """The bytes of a gzip member, a piece at a time."""

    def __init__(self, source: Source, at: int):
        self.source, self.at, self.z, self.out, self.step = source, at, zlib.decompressobj(31), b"", 512
        self.first, self.seen = at, False

    def read(self, n: int) -> bytes:
        parts, size = [self.out], len(self.out)
        while size < n and not self.z.eof:
            data, self.step = self.source.byte_range(self.at, self.step), min(2 * self.step, 1 << 16)
            if not data:
                raise Damaged("the file ends within a member")
            try:
                parts.append(self.z.decompress(data, 1 << 20))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            self.at += len(data) - len(self.z.unused_data) - len(self.z.unconsumed_tail)
            size += len(parts[-1])
            self.seen = self.seen or size > 0
            if not self.seen and self.at - self.first > GZIP_HEADER_BYTES:
                raise Damaged("a gzip header without an end")
        out = b"".join(parts)
        self.out = out[n:]
        return out[:n]

    def finish(self) -> int:
        if self.read(1) or not self.z.eof:
            raise Damaged("bytes after the record in its member")
        return self.at


def _headers(stream) -> tuple[list[str], dict[str, str], bytes]:
    """(first line, headers, what was read beyond them)."""
    data = b""
    while (end := data.find(END)) < 0:
        more = stream.read(4096)
        if not more or len(data) > HEADER_BYTES:
            raise Damaged("headers without an end")
        data += more
        if not VERSION.match(data[:16]) and len(data) >= 16:
            raise Damaged("no version line")
    if not VERSION.match(data):
        raise Damaged("no version line")
    lines = re.sub(r"\r\n[ \t]+", " ", data[:end].decode("utf-8", "replace")).split("\r\n")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or CONTROL.search(line) or (name in head and name != "warc-concurrent-to"):
            raise Damaged("a header without a colon, with control characters, or one that stands twice")
        head[name] = value.strip()
    return lines[0], head, data[end + len(END) :]


def _digest_holds(said: str | None, data: bytes) -> bool:
    """False only if said is a SHA-1 in base 32 that isn't that of data."""
    name, _, value = (said or "").partition(":")
    return name.lower() != "sha1" or len(value) != 32 or value.upper() == sha1_base32(data)


def _http(block: bytes) -> tuple[bytes, int | None]:
    """(payload, its length as the headers say) of an HTTP message."""
    head, end, payload = block.partition(END)
    said = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", head, re.I)
    return payload if end else b"", int(said[1]) if said else None


def one_record(source: Source, at: int) -> tuple[dict, int]:
    """The record at this place, whole and checked, and where it ends. Damaged says what is wrong with it."""
    begin = source.byte_range(at, 16)
    if begin.startswith(MAGIC):
        stream = Member(source, at)
    elif VERSION.match(begin):
        stream = Plain(source, at)
    else:
        raise Damaged("neither a member nor a version line")
    _, head, rest = _headers(stream)
    length = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in head or "warc-record-id" not in head:
        raise Damaged("a needed header is missing")
    need = int(length) + len(END)
    if isinstance(stream, Plain):
        stream.at -= len(rest)
        if need > READ and source.byte_range(stream.at + need - len(END), len(END)) != END:  # before all of it is read
            raise Damaged("the block isn't as long as its header says")
        body = stream.read(need)
    else:
        body = rest + stream.read(need - len(rest)) if need > len(rest) else rest
    if len(body) != need or body[-len(END) :] != END:
        raise Damaged("the block isn't as long as its header says")
    end, block, kind = stream.finish(), body[: -len(END)], head["warc-type"].lower()
    if not _digest_holds(head.get("warc-block-digest"), block):
        raise Damaged("the block's digest differs")
    payload, said = _http(block) if head.get("content-type", "").startswith("application/http") else (block, None)
    if kind != "revisit":
        if not _digest_holds(head.get("warc-payload-digest"), payload):
            raise Damaged("the payload's digest differs")
        said = len(payload)
    bare = lambda name: head[name].strip("<>") if name in head else None
    return {
        "record_id": bare("warc-record-id"), "type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": bare("warc-refers-to"),
        "payload_digest": (head.get("warc-payload-digest") or f"sha1:{sha1_base32(payload)}").partition(":")[2], "payload_bytes": said, "payload": None if kind == "revisit" else payload,
    }, end


def salvaged(file) -> Iterator[dict]:
    """Records (kind record) and quarantined bytes (kind gap) of a file in its order."""
    source, at = Source(file), 0
    gap, reason = None, None
    while True:
        try:
            if not source.byte_range(at, 1):
                break
            found, end = one_record(source, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            if (at := source.find(at + 1)) is None:
                break
            continue
        if gap is not None:
            yield {"kind": "gap", "at": gap, "bytes": at - gap, "reason": reason}
            gap = None
        yield {"kind": "record", "at": at, "bytes": end - at} | found
        at = end
    if gap is not None:
        yield {"kind": "gap", "at": gap, "bytes": file.size() - gap, "reason": reason}


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """COLUMNS of every record and gap in the files (path, in folder); a task reads whole files, a record at a time."""
    names = [f.split()[0] for f in COLUMNS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in COLUMNS.split(", ")])

    def run(batches):
        system, base = open_fs(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with system.open_input_file(f"{base}/{path}") as file:
                    for row in salvaged(file):
                        row["path"] = path
                        if not payloads:
                            row["payload"] = None
                        rows.append({n: row.get(n) for n in names})
                        size += 500 + len(row.get("payload") or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path").repartition(tasks, "path").mapInArrow(run, COLUMNS)


def round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from its archive."""
    folder = new_path(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, folder, revisit_bytes), folder, payloads=False).filter("kind = 'record' and type in ('response', 'revisit')")
    return back.select(page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_id_of("refers_to").alias("refers_to"))
