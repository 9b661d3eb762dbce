"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Archives are gzip files with one member for each record. The reader walks them member by member
(or, in plain archives, record by record), piece by piece: a record of any size is digested as it
passes, and only its headers are held. When a check fails - gzip's CRC or length, the version line,
the header block, the block's length, its digest - it searches for the next member or version line
that starts a valid record, goes on from there, and logs the bytes in between as a quarantined gap.
A plain record's end is looked at before its block is read, so a damaged length costs nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed values of the formats.
GZIP_START = b"\x1f\x8b\x08"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
VERSION_START = b"WARC/1."
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
#: Reads are of so many bytes.
CHUNK = 1 << 20
#: Decompressed data come in pieces of so many bytes.
PIECE = 1 << 18
#: A header block is held in memory: longer ones are damage to the reader, and the writer raises for them.
MOST_HEADER = 1 << 26
#: So much of an HTTP head is kept to be looked at.
MOST_HTTP = 1 << 16
END = b"\r\n\r\n"
HEADER_LINE = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*:")


class Damage(Exception):
    pass


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit's block holds the HTTP headers of its payload, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        head += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = VERSIONS[1] + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    if len(lines) > MOST_HEADER:
        raise ValueError(f"page {page_id}: a header block of {len(lines)} bytes (at most {MOST_HEADER})")
    return lines + block + END


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Record:
    """One record, parsed from pieces of its bytes; any failed check raises :class:`Damage`.

    ``head`` are its headers; of the block, ``http`` is (the beginning of) what stands before the first
    blank line, and ``payload_bytes``, ``payload_sha256`` and, if kept, ``payload`` are of what follows.
    """

    def __init__(self, keep: bool = False):
        self.head: dict[str, str] = {}
        self.http, self.payload_bytes, self.payload = b"", 0, bytearray() if keep else None
        self._lines, self._checked, self._from = bytearray(), 0, 0
        self._left: int | None = None  # bytes of the block to come
        self._in_payload, self._last, self._end = False, b"", b""
        self._block, self._payload = hashlib.sha256(), hashlib.sha256()
        self.done = False

    @property
    def payload_sha256(self) -> str:
        return self._payload.hexdigest()

    def feed(self, data) -> int:
        """Takes what belongs to the record from a piece; returns how many bytes that were."""
        data, used = memoryview(data), 0
        if self._left is None:
            used = self._feed_head(data)
        if self._left:
            part = data[used : used + self._left]
            self._feed_block(part)
            self._left -= len(part)
            used += len(part)
        if self._left == 0 and not self.done:
            part = bytes(data[used : used + len(END) - len(self._end)])
            self._end += part
            used += len(part)
            if not END.startswith(self._end):
                raise Damage("no end of the record")
            if self._end == END:
                self._check_digest()
                self.done = True
        return used

    def _feed_head(self, data: memoryview) -> int:
        lines, before = self._lines, len(self._lines)
        lines += data[: max(0, MOST_HEADER + len(END) - before)]
        if not any(v.startswith(lines[: len(v)]) for v in VERSIONS):
            raise Damage("no version line")
        at = lines.find(END, max(0, before - len(END) + 1))
        whole = at if at >= 0 else lines.rfind(b"\r\n")
        while self._checked < whole:
            end = lines.find(b"\r\n", self._checked, whole)
            end = whole if end < 0 else end
            if self._checked and not HEADER_LINE.match(lines, self._checked, end):
                raise Damage("a header line without a colon")
            self._checked = end + 2
        if at < 0:
            if len(lines) > MOST_HEADER:
                raise Damage("no end of the header block")
            return len(data)
        for line in bytes(lines[:at]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            self.head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        size = self.head.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or not self.head.get("warc-type"):
            raise Damage("no length or type")
        self._left = int(size)
        self._lines = bytearray()
        return at + len(END) - before

    def _feed_block(self, part: memoryview) -> None:
        self._block.update(part)
        if not self._in_payload:
            joined = self._last + bytes(part)
            at = joined.find(END)
            head = joined[len(self._last) : at if at >= 0 else None] if at >= len(self._last) or at < 0 else b""
            self.http += head[: MOST_HTTP - len(self.http)]
            if at < 0:
                self._last = joined[-len(END) + 1 :]
                return
            self._in_payload = True
            part = memoryview(joined)[at + len(END) :]
        self._payload.update(part)
        self.payload_bytes += len(part)
        if self.payload is not None:
            self.payload += part

    def _check_digest(self) -> None:
        kind, _, want = self.head.get("warc-block-digest", "").partition(":")
        if kind == "sha256" and self._block.hexdigest() != want:
            raise Damage("wrong digest")


class _Source:
    """A file's bytes by place. Going on from where the last piece ended reads each byte once."""

    def __init__(self, f, size: int):
        self.f, self.size, self.start, self.buf = f, size, 0, b""

    def piece(self, at: int) -> memoryview:
        """What is at hand from ``at`` on; empty at the end of the file."""
        if not self.start <= at < self.start + len(self.buf):
            if at != self.start + len(self.buf) or not self.buf:
                self.f.seek(at)
            self.start, self.buf = at, self.f.read(min(CHUNK, max(0, self.size - at)))
        return memoryview(self.buf)[at - self.start :]

    def peek(self, at: int, n: int) -> bytes:
        """``n`` bytes, or as many as there are; what is at hand stays."""
        if self.start <= at and at + n <= self.start + len(self.buf):
            return bytes(self.buf[at - self.start : at - self.start + n])
        self.f.seek(at)
        out = self.f.read(n)
        self.f.seek(self.start + len(self.buf))
        return bytes(out)

    def next_start(self, at: int) -> int:
        """The next place from ``at`` on where a member or a record could start; else the end."""
        carry = b""
        while data := self.piece(at):
            joined = carry + bytes(data)
            hits = [i for i in (joined.find(GZIP_START), joined.find(VERSION_START)) if i >= 0]
            if hits:
                return at - len(carry) + min(hits)
            at += len(data)
            carry = joined[-len(VERSION_START) + 1 :]
        return self.size


def _member(source: _Source, at: int, keep: bool) -> tuple[Record, int]:
    """The record in the gzip member at ``at``, and the member's stored length."""
    z, record, pos = zlib.decompressobj(31), Record(keep), at
    while not z.eof:
        piece = source.piece(pos)[:PIECE]
        if not piece:
            raise Damage("the member is cut off")
        pos += len(piece)
        while piece and not z.eof:
            try:
                data = z.decompress(piece, PIECE)
            except zlib.error as e:
                raise Damage(str(e)) from None
            if record.feed(data) != len(data):
                raise Damage("bytes after the record")
            piece = z.unconsumed_tail
    if not record.done:
        raise Damage("short block")
    return record, pos - len(z.unused_data) - at


def _plain(source: _Source, at: int, keep: bool) -> tuple[Record, int]:
    """The record at ``at`` of a plain archive, and its length."""
    record, pos, looked = Record(keep), at, False
    while not record.done:
        piece = source.piece(pos)[:PIECE]
        if not piece:
            raise Damage("short block" if record.head else "no end of the header block")
        pos += record.feed(piece)
        if record.head and not looked:
            looked = True
            end = pos + (record._left or 0)
            if record._left and source.peek(end, len(END)) != END:
                raise Damage("no end of the record" if end + len(END) <= source.size else "short block")
    return record, pos - at


def salvage(f, size: int, payloads: bool = False) -> Iterator[tuple]:
    """``("record", offset, length, headers, record)`` and ``("gap", offset, length, reason)``, in order.

    Every byte of the file (which can seek) lies in exactly one of them. ``record`` is a
    :class:`Record`; its payload's bytes are held only if ``payloads``.
    """
    source = _Source(f, size)
    at, gap, why = 0, None, ""
    while at < size:
        try:
            first = source.peek(at, len(VERSION_START))
            if not first.startswith((GZIP_START, VERSION_START)):
                raise Damage("neither a member nor a record")
            record, used = (_member if first.startswith(GZIP_START) else _plain)(source, at, payloads)
        except Damage as e:
            if gap is None:
                gap, why = at, str(e)
            at = source.next_start(at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why
            gap = None
        yield "record", at, used, record.head, record
        at += used
    if gap is not None:
        yield "gap", gap, size - gap, why


ARCHIVES = "path string, n_records long, n_bytes long"


def with_first(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` (null: empty), ``digest``, ``refers_to``.

    ``refers_to`` is the smallest page of the same payload if this isn't it and the payload has
    at least :data:`LEAST_REVISIT` bytes. Only digests that repeat are joined back.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    firsts = shared.written(p.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first-pages")
    total = p.agg(F.count("*")).first()[0]
    # pages that very many repeat stay where they are, html and all
    both = shared.looked_up(p, firsts, ["digest"], total)
    return both.withColumn("refers_to", F.expr("case when first < page_id or page_id is null then first end")).drop("first", "n")


def write_archives(pages: DataFrame, directory: str) -> DataFrame:
    """Write every row of ``pages`` as a record of gzip archives in ``directory``; returns their list.

    The payload is the html in UTF-8. Of equal payloads of 100 bytes or more, that with the
    smallest page is a response and others revisit it; rows that repeat that page's id are
    responses too, and a null id revisits. Each task writes one archive of its own name.
    """
    shared.ready(pages.sparkSession)

    def run(batches):
        ctx = TaskContext.get()
        path = f"{directory}/pages-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for b in shared.slices(batches, 200):
            for page_id, url, html, digest, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    store, name = fs.FileSystem.from_uri(path)
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name, compression=None)
                data = gzip_member(build_record(page_id, url, html.encode(), digest, first))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    rows = with_first(pages).select("page_id", "url", "html", "digest", "refers_to")
    return shared.written(rows.mapInArrow(run, ARCHIVES), "archives")


READ = "kind string, path string, offset long, length long, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False, complete: bool = False) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined gaps (``kind = 'gap'``) of the archives listed.

    ``payload_bytes`` and ``payload_digest`` are of the full payload: for a response computed from
    the block, for a revisit as its HTTP headers and digest field say. ``payloads`` adds the bytes.
    A gap has nulls in the columns of records; an empty list of archives gives no rows. Where
    ``complete`` and ``archives`` has ``n_records``, an archive with fewer or more records raises.
    """
    complete = complete and "n_records" in archives.columns
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, held, n_read = [], 0, 0
                with store.open_input_file(name) as f:
                    for kind, at, length, *rest in salvage(f, f.size(), payloads):
                        row = [kind, path, at, length] + [None] * (7 + payloads)
                        if kind == "gap":
                            row[4] = rest[0]
                        else:
                            head, record = rest
                            n_read += 1
                            revisit = head["warc-type"] == "revisit"
                            said = re.search(rb"(?i)^content-length:\s*(\d+)", record.http, re.M)
                            row[5:] = [
                                head["warc-type"], _int(head.get("x-page-id")), head.get("warc-target-uri"), int(said[1]) if revisit and said else record.payload_bytes,
                                head.get("warc-payload-digest", "").partition(":")[2] if revisit else record.payload_sha256, _int(head.get("x-refers-to-page-id")),
                            ] + ([bytes(record.payload)] if payloads else [])
                            held += record.payload_bytes * payloads
                        rows.append(row)
                        if len(rows) >= 1000 or held >= 1 << 24:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)
                if complete and n_read != expected:
                    raise RuntimeError(f"{path}: {n_read} records read, {expected} written")

    expected = F.col("n_records") if "n_records" in archives.columns else F.lit(None).cast("long")
    return archives.select("path", expected.alias("n_records")).repartition(n).mapInArrow(run, READ + (", payload binary" if payloads else ""))


def _int(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"-?\d+", x) else None


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
