"""WARC archives: a writer, and a reader that salvages damaged files (operator 9).

Writer: one gzip member per record, one file per task attempt in the shared folder; only the files of committed attempts are named in the result, so
lost, repeated or speculative attempts leave at most files that nobody reads.  Equal payloads (by SHA-256) of ``REVISIT_BYTES`` octets or more are
stored once, under the largest page_id; the others become revisit records, which carry the digest and the length but no payload.  Which those are is
decided on rows of ids and digests; payloads are joined with the decisions by page_id, so a payload with a million copies is no hot key.

Salvage reader: files are read in bounded chunks.  A member must decompress with a right checksum (it is inflated in bounded steps; one of over
``HELD_BYTES`` is inflated a second time to be read), a record must have a version line, headers, its stated length, its closing line ends and its stated
payload digest (SHA-1, SHA-256 or MD5; in hex or base32).  After a failed check the reader searches for the next valid member (gzip files) or version
line (plain files, and inside a member) and goes on; every stretch it had to skip is logged as a gap of its own, with its place in the file and, inside
a member, its place in the member's content.

Nulls: a null html is an empty payload, a null url has no Target-URI, a null page_id reads back as null.
Repeated rows: all rows with the largest page_id of equal payloads are responses.  Extra columns are
ignored.  An empty table writes no file and reads back empty.  A record is held whole in memory (and as much of a file as a damaged
length claims), a file or member is not.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import materialize, scratch_path, table

REVISIT_BYTES = 1000
#: Octets that a record's headers are first looked for in; longer ones are read on.
CHUNK, HEADER_BYTES = 1 << 20, 1 << 16
#: A member's content of up to so many octets is kept from the check of its checksum.
HELD_BYTES = 1 << 24
VERSION, MAGIC, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
FILES = "path string, records long, bytes long"
ENTRIES = "path string, begin long, end long, inner_begin long, inner_end long, problem string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None, digest: str) -> bytes:
    return b"<urn:page:%s:%s>" % (b"" if page_id is None else b"%d" % page_id, digest.encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, size: int | None = None) -> bytes:
    """One uncompressed WARC record; ``digest`` is the payload's SHA-1 in hex, ``size`` its length if the payload isn't given."""
    head = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _urn(page_id, digest),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
        b"X-Payload-Length: %d" % (len(payload) if size is None else size),
        b"Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~").encode())
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to, digest)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block += b"" if revisit else payload
    head.append(b"Content-Length: %d" % len(block))
    return VERSION + b"\r\n".join(head) + END + block + END


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Entry:
    """A record, or with ``problem`` a gap; begin and end are places in the file (of the member), inner_begin and inner_end in the member's content."""

    begin: int
    end: int
    problem: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    inner_begin: int | None = None
    inner_end: int | None = None


class _Window:
    """A stream's octets: ``buf`` from ``pos`` on, more as needed; ``base`` is the place of buf's start."""

    def __init__(self, file) -> None:
        self.file, self.base, self.buf, self.pos, self.ended = file, 0, b"", 0, False

    @property
    def place(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        """One more chunk at least; what lies before pos goes."""
        if not self.ended:
            new = self.file.read(max(CHUNK, len(self.buf) - self.pos))
            self.ended = not new
            self.base, self.buf, self.pos = self.place, self.buf[self.pos :] + new, 0
        return not self.ended

    def have(self, n: int) -> bool:
        while len(self.buf) - self.pos < n and self.more():
            pass
        return len(self.buf) - self.pos >= n

    def back(self, place: int) -> None:
        """Moves to a place that may have gone."""
        if place < self.base or place > self.base + len(self.buf):
            self.file.seek(place)
            self.base, self.buf, self.ended = place, b"", False
        self.pos = place - self.base

    def seek_to(self, what: re.Pattern[bytes], width: int) -> bool:
        """Moves to the next match after pos (matches are ``width`` octets long), or to the end."""
        at = self.pos + 1
        while not (hit := what.search(self.buf, at)):
            at = max(at, len(self.buf) - width + 1) - self.pos  # what was searched stays searched
            self.pos, at = self.pos + at - 1, 1
            if not self.more():
                self.pos = len(self.buf)
                return False
            at += self.pos
        self.pos = hit.start()
        return True


def _stated(said: str, payload: bytes) -> bool | None:
    """Whether a payload has the stated digest; None if that can't be told."""
    kind, _, value = said.partition(":")
    try:
        octets = hashlib.new(kind.strip().lower().replace("-", ""), payload, usedforsecurity=False).digest()
    except ValueError:
        return None
    value = value.strip()
    if len(value) == 2 * len(octets):
        return value.lower() == octets.hex()
    return value.upper().rstrip("=") == base64.b32encode(octets).decode().rstrip("=")


def parse(w: _Window) -> tuple[int, Entry] | str:
    """The record at the window's place: its length and itself, or what is wrong."""
    size = HEADER_BYTES
    w.have(size)
    line = _VERSION_LINE.match(w.buf, w.pos)
    if not line:
        return "no version line"
    after = line.end() - w.pos
    at = after - 2
    while (stop := w.buf.find(END, w.pos + at)) < 0:
        # a long header: twice as many octets each time, up to the next record or the end
        if _VERSION_LINE.search(w.buf, w.pos + max(at, after)) or len(w.buf) - w.pos < size:
            return "no end of headers"
        at = max(at, len(w.buf) - w.pos - len(VERSION))
        size = 2 * (len(w.buf) - w.pos)
        w.have(size)
    headers = {}
    for x in w.buf[w.pos + after : stop].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon:
            return "bad header"
        headers[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no length"
    begin = stop + 4 - w.pos
    end = begin + int(length)
    if not w.have(end + 4):
        return "cut short"
    if w.buf[w.pos + end : w.pos + end + 4] != END:
        return "no end of record"
    block = w.buf[w.pos + begin : w.pos + end]
    payload = block.partition(END)[2] if headers.get("content-type", "").lower().startswith("application/http") else block
    if headers.get("warc-type") != "revisit" and _stated(headers.get("warc-payload-digest", ""), payload) is False:
        return "wrong digest"
    return end + 4, Entry(0, 0, None, headers, payload)


def _plain(w: _Window) -> Iterator[Entry]:
    """Records and gaps of a stream of records."""
    gap: tuple[int, str] | None = None
    while w.have(1):
        got = parse(w)
        if isinstance(got, str):
            gap = gap or (w.place, got)
            w.seek_to(_VERSION_LINE, len(VERSION))
            continue
        if gap:
            yield Entry(gap[0], w.place, gap[1])
            gap = None
        size, entry = got
        entry.begin, entry.end = w.place, w.place + size
        w.pos += size
        yield entry
    if gap:
        yield Entry(gap[0], w.place, gap[1])


class _Member:
    """The content of the gzip member at a window's place, as a stream; afterwards ``problem`` tells what was wrong."""

    def __init__(self, w: _Window) -> None:
        self.w, self.z, self.problem, self.fed = w, zlib.decompressobj(31), None, w.place

    def read(self, n: int) -> bytes:
        z, w = self.z, self.w
        while not z.eof and not self.problem:
            data = z.unconsumed_tail
            if not data:
                w.pos = self.fed - w.base  # what was inflated may go
                if self.fed == w.base + len(w.buf) and not w.more():
                    self.problem = "cut short"
                    break
                data = w.buf[self.fed - w.base : self.fed - w.base + CHUNK]
                self.fed += len(data)
            try:
                out = z.decompress(data, n)
            except zlib.error:
                self.problem = "bad member"
                break
            if out:
                return out
        return b""

    def end(self) -> int:
        """The place after the member, when all was read."""
        return self.fed - len(self.z.unused_data)


_MAGIC = re.compile(re.escape(MAGIC))


def _zipped(w: _Window) -> Iterator[Entry]:
    gap: tuple[int, str] | None = None
    while w.have(1):
        begin, problem = w.place, "no member"
        if w.have(len(MAGIC)) and w.buf.startswith(MAGIC, w.pos):
            content, held, size = _Member(w), [], 0
            while part := content.read(CHUNK):
                size += len(part)
                if size <= HELD_BYTES:
                    held.append(part)
            problem, end = content.problem, content.end()
        if problem:
            gap = gap or (begin, problem)
            w.back(begin)
            w.seek_to(_MAGIC, len(MAGIC))
            continue
        if gap:
            yield Entry(gap[0], begin, gap[1])
            gap = None
        if size > HELD_BYTES:
            w.back(begin)
        for e in _plain(_Window(_Member(w) if size > HELD_BYTES else io.BytesIO(b"".join(held)))):
            e.inner_begin, e.inner_end, e.begin, e.end = e.begin, e.end, begin, end
            yield e
        w.back(end)
    if gap:
        yield Entry(gap[0], w.place, gap[1])


def salvage(file: BinaryIO, zipped: bool) -> Iterator[Entry]:
    """All records that can be read, and the gaps between them, in file order; ``file`` can seek."""
    return (_zipped if zipped else _plain)(_Window(file))


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)(:.*)?>", urn or "")
    return int(m[1]) if m else None


def _store(uri: str):
    """File system and path of a URI; Hadoop's names of object stores are understood too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the files written: each call of an action on it writes them; materialize it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_same", F.sha2("html", 256))
    ids = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.col("_same").alias("_k"))
    kept = ids.groupBy("_k").agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_k").alias("_g"), "_kept")
    # ids of copies are many per payload: both sides of the join are plain shuffles, which Spark can split
    told = ids.join(materialize(kept, "warc-kept"), F.col("_k") == F.col("_g")).select(F.col("page_id").alias("_id"), "_k", "_kept").filter(~F.col("_id").eqNullSafe(F.col("_kept")))
    told = materialize(told.distinct(), "warc-revisits")
    rows = rows.join(told, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_k")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("_kept").isNull(), F.encode("html", "UTF-8")).alias("html"), F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("digest"), "_kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _store(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for b in batches:
            for page_id, url, html, length, digest, kept in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns)), strict=True):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, url, html.as_py() or b"", digest, kept, kept is not None, length))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([size])], names=["path", "records", "bytes"])

    return rows.mapInArrow(run, FILES)


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """Records and gaps (``problem`` not null) of the files in ``files.path``; with the payloads if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRIES.split(", ")] + ["payload"] * payload
        kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in ENTRIES.split(", ")] + [pa.binary()] * payload

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for e in salvage(file, path.endswith(".gz")):
                        h, revisit = e.headers, e.headers.get("warc-type") == "revisit"
                        size = int(h["x-payload-length"]) if revisit and h.get("x-payload-length", "").isdigit() else len(e.payload)
                        uri = h.get("warc-target-uri")
                        row = (path, e.begin, e.end, e.inner_begin, e.inner_end, e.problem, _page(h.get("warc-record-id")), None if uri is None else unquote(uri))
                        row += (None,) * 4 if e.problem else (size, _hex(h.get("warc-payload-digest")) if revisit else hashlib.sha1(e.payload).hexdigest(), h.get("warc-type"), _page(h.get("warc-refers-to")))
                        rows.append(row + (e.payload,) * payload)
                        held += len(e.payload) * payload
                        if len(rows) >= 5000 or held > 1 << 25:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("path").mapInArrow(run, ENTRIES + ", payload binary" * payload)


def _hex(said: str | None) -> str | None:
    """A stated SHA-1 in hex, whether it is in hex or base32; else null."""
    kind, _, value = (said or "").partition(":")
    if kind.lower().replace("-", "") != "sha1":
        return None
    try:
        return value.lower() if re.fullmatch("[0-9A-Fa-f]{40}", value) else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if a record is not read back or a gap is found: the files are its own."""
    files = materialize(write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")), "warc-files")
    n = max(1, spark.sparkContext.defaultParallelism)
    found = read_archives(files.repartition(4 * n))
    found = materialize(found.select("problem", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read, gaps = found.agg(F.count(F.when(F.col("problem").isNull(), 1)), F.count("problem")).first()
    if gaps or read != written:
        raise RuntimeError(f"{written} records written, {read} read back, {gaps} gaps")
    return found.drop("problem")


ORACLE = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h)
"""
