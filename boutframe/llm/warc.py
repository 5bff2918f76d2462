"""WARC archives: a writer with revisits, and a reader that salvages what damage has left.

Archives are written by the tasks that hold the pages, through pyarrow's file systems, under names
of their own for each attempt; the manifest of the committed attempts says which of them count.
The reader streams an archive member by member, and a member record by record. Where a check fails
it looks for the next version line of the member, or the next gzip member or version line of the
archive, from which a whole record can be read, and logs the bytes between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.tables import small_batches
from boutframe.session import written

ARCHIVE_BYTES = 64 << 20
CRAWL_DATE = "2024-01-01T00:00:00Z"
PAGE_URN = "urn:page:"
# FIXED VALUES of the format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"

#: A header that has not ended after so many bytes is damage.
HEADER_BYTES = 4 << 20

_CHUNK = 1 << 20
_FINE = 1 << 16
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER_END = b"\r\n\r\n"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing -----------------------------------------------------------------
def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(revisit_id, revisit_sha1, refers_to) of pages whose payload a smaller id holds, null the largest."""
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    keys = pages.select(pages[id_col].alias("id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    keys = written(keys.filter(F.col("n") >= least_bytes), "warc-keys")
    first = keys.groupBy("sha1", "n").agg(F.min("id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    first = written(first.withColumnsRenamed({"sha1": "s", "n": "m"}), "warc-first")
    # Written sides, one row per payload: adaptive joins split the pages of a hot payload.
    again = keys.join(first, (F.col("sha1") == F.col("s")) & (F.col("n") == F.col("m")))
    again = again.filter("refers_to IS NOT NULL AND NOT (id <=> refers_to)")
    return again.select(F.col("id").alias("revisit_id"), F.col("sha1").alias("revisit_sha1"), "refers_to").distinct()


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; the manifest (path, records, bytes).

    Of pages with equal payloads of at least ``least_bytes``, that with the smallest id is a
    response and the others revisit it; rows repeating that id are responses too. A null html is
    an empty payload, a null url leaves the target out, a null id the number in the record's name.
    Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    known = written(revisits(pages, id_col, html_col, least_bytes), "warc-revisits")
    rows = pages.select(
        pages[id_col].cast("string").alias("id"),
        pages[url_col].alias("url"),
        F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"),
        pages[id_col].alias("key"),
    ).withColumn("sha1", F.sha1("payload"))
    # The written table of revisits has a known size, which picks the join.
    same = F.col("key").eqNullSafe(F.col("revisit_id")) & (F.col("sha1") == F.col("revisit_sha1"))
    rows = rows.join(known, same, "left")
    rows = rows.select("id", "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = fs.FileSystem.from_uri(folder)
        target.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out, records, size = target.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                member = compress(record(*(x.as_py() for x in row)))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
            names=["path", "records", "bytes"],
        )

    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record, uncompressed: a response, or a revisit if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{PAGE_URN}{page_id if page_id is not None else ''}>",
        "WARC-Date": CRAWL_DATE,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "WARC-Block-Digest": f"sha1:{digest32(block)}",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        headers |= {"WARC-Refers-To": f"<{PAGE_URN}{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def compress(data: bytes) -> bytes:
    """One gzip member without a time, so the same record has the same bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


# --- reading -----------------------------------------------------------------
class Damaged(Exception):
    """A check failed; the text says which."""


@dataclass
class Found:
    """A record, or with a reason a gap, at ``start`` to ``end`` of the archive.

    All that a member holds has the member's place, and with it ``inner``, its own among the
    unpacked bytes; a gap without that is the whole stretch. Of a member that breaks off, records
    end where bytes of the archive that may belong to something else begin, as does its gap.
    """

    start: int
    end: int
    reason: str | None = None
    inner: tuple[int, int] | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int | None = None
    proven: bool = False  # by a digest


class Source:
    """An archive read in chunks; only the chunk in use and the record being read are held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if not self.base <= pos <= pos + n <= self.base + len(self.held):
            if pos + n > self.size:
                n = max(0, self.size - pos)
            self.file.seek(pos)
            self.base, self.held = pos, self.file.read(max(n, min(_CHUNK, self.size - pos)))
        return self.held[pos - self.base : pos - self.base + n]

    def find(self, pattern: re.Pattern, pos: int, overlap: int) -> int:
        """Where ``pattern``, at most ``overlap`` bytes long, is next found, or the size."""
        while pos < self.size:
            chunk = self.at(pos, min(_CHUNK, self.size - pos))
            if m := pattern.search(chunk):
                return pos + m.start()
            if pos + len(chunk) >= self.size:
                break
            pos += len(chunk) - overlap
        return self.size


class Unpacked:
    """The unpacked bytes of a member, read front to back; bytes behind the reader are let go."""

    def __init__(self, source: Source, start: int, step: int = _CHUNK):
        self.source, self.pos, self.step, self.size = source, start, step, None
        self.unpack, self.base, self.held = zlib.decompressobj(31), 0, bytearray()
        self.ended, self.reason, self.pending, self.most = False, None, b"", step
        #: How far the bytes reached after each step, and the archive's bytes read before it.
        self.marks: list[tuple[int, int]] = []

    @property
    def reached(self) -> int:
        return self.base + len(self.held)

    def more(self) -> bool:
        """Unpack a step more; false at the end of the member or of what can be unpacked."""
        while not self.ended:
            packed = self.pending
            if not packed:
                packed = self.source.at(self.pos, min(self.step, self.source.size - self.pos))
                self.pos += len(packed)
            before, part = self.pos - len(packed), packed[: self.most]
            saved = self.unpack.copy()
            try:
                out = self.unpack.decompress(part, self.step)
                break
            except zlib.error:
                # What comes before the damage is had from shorter parts.
                self.unpack, self.pending, self.most = saved, packed, max(1, len(part) // 2)
                if len(part) <= 1:
                    self.ended, self.reason = True, "bad member"
        else:
            return False
        self.pending = self.unpack.unconsumed_tail + packed[len(part) :]
        self.held += out
        self.marks.append((self.reached, before))
        if self.unpack.eof:
            self.ended, self.pos = True, self.pos - len(self.unpack.unused_data) - len(self.pending)
        elif not packed and not out:
            self.ended, self.reason = True, "truncated member"
        return not self.ended or bool(out)

    def at(self, pos: int, n: int) -> bytes:
        while self.reached < pos + n and self.more():
            pass
        return bytes(self.held[pos - self.base : pos - self.base + n])

    def find(self, pattern: re.Pattern, pos: int, overlap: int) -> int:
        """As that of :class:`Source`; bytes before what is found are let go."""
        while True:
            chunk = self.at(pos, _CHUNK)
            if m := pattern.search(chunk):
                return pos + m.start()
            if len(chunk) < _CHUNK:
                return self.size
            pos += len(chunk) - overlap
            self.let_go(pos)

    def let_go(self, pos: int) -> None:
        del self.held[: pos - self.base]
        self.base = pos
        while len(self.marks) > 1 and self.marks[0][0] < pos:
            self.marks.pop(0)

    def own_until(self, pos: int) -> int:
        """A place of the archive up to which its bytes were needed for those before ``pos``."""
        return next(before for reached, before in self.marks if reached >= pos)


def scan(source: Source) -> Iterator[Found]:
    """Records in order; each stretch that no record could be read from is one gap."""
    gap = None
    for found in _pieces(source):
        if gap and found.reason and found.inner is None:
            gap.end = found.end
            continue
        if gap:
            yield gap
            gap = None
        if found.reason and found.inner is None:
            gap = found
        else:
            yield found
    if gap:
        yield gap


def _pieces(source: Source) -> Iterator[Found]:
    pos = 0
    while pos < source.size:
        if source.at(pos, len(MEMBER)) == MEMBER:
            member = Unpacked(source, pos)
            while member.more():  # the checksum and size of the whole, in bounded memory
                member.let_go(member.reached)
            whole, size, end = member.reason is None, member.reached, member.pos
            fresh = Unpacked(source, pos, _CHUNK if whole else _FINE)
            fresh.size, own = size, pos
            for found in _records(fresh, pos, end if whole else None):
                own = found.end
                yield found
            if whole:
                pos = end
                continue
            problem, ahead = member.reason, max(pos + 1, own)
        else:
            try:
                found = _plain(source, pos)
                yield found
                pos = found.end
                continue
            except Damaged as damage:
                problem, own, ahead = str(damage), pos, pos + 1
        following = source.find(_START, ahead, 16)
        yield Found(own, following, problem)
        pos = following


def _records(member: Unpacked, start: int, end: int | None) -> Iterator[Found]:
    """Records of a member and the gaps between; without an ``end`` it breaks off.

    Of a member that breaks off only records that a digest proves are taken, and what follows the
    last of them is no gap of its own.
    """
    at, gap, reason, own = 0, None, None, start
    while at < member.size:
        member.let_go(at)
        try:
            found = _plain(member, at)
            if end is None and not found.proven:
                raise Damaged("unproven record of a broken member")
        except Damaged as problem:
            if gap is None:
                gap, reason = at, "member without a version line" if not at and str(problem) == _NO_VERSION else str(problem)
            at = member.find(_VERSION_LINE, at + 1, 16)
            continue
        inner = (found.start, found.end)
        until = end if end is not None else max(own, member.own_until(found.end))
        if gap is not None:
            yield Found(start, until, reason, (gap, at))
            gap = None
        own, at = until, found.end
        yield replace(found, start=start, end=until, inner=inner)
    if end is not None and (gap is not None or not member.size):
        whole = gap in (0, None)
        yield Found(start, end, reason or "empty member", None if whole else (gap, member.size))


_NO_VERSION = "no version line"


def _plain(source: Source | Unpacked, start: int) -> Found:
    if not _VERSION_LINE.match(source.at(start, 10)):
        raise Damaged(_NO_VERSION)
    held = _CHUNK // 16
    while (head := source.at(start, min(held, source.size - start))).find(_HEADER_END) < 0:
        if held >= HEADER_BYTES or len(head) < held:
            raise Damaged("truncated header")
        held *= 4
    body = head.find(_HEADER_END) + 4
    length = _headers(head[: body - 4]).get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("bad content length")
    total = body + int(length) + 4
    if start + total > source.size:
        raise Damaged("truncated record")
    return _record(source.at(start, total), start)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    named = [line.split(":", 1) for line in lines[1:] if line]
    if any(len(x) != 2 for x in named):
        raise Damaged("bad header line")
    return {k.strip().lower(): v.strip() for k, v in named}


def _record(data: bytes, start: int) -> Found:
    """The record that ``data`` begins with, after all checks."""
    head = data.find(_HEADER_END)
    if head < 0 or not re.match(rb"WARC/1\.[01]\r\n", data):
        raise Damaged("no header")
    headers = _headers(data[:head])
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("bad content length")
    body, end = head + 4, head + 4 + int(length)
    block = data[body:end]
    if len(block) < int(length) or data[end : end + 4] != _HEADER_END:
        raise Damaged("record end is not where its length says")
    proven = _check(headers, "warc-block-digest", block)
    payload, n = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_HEADER_END)
        n = len(payload)
        if headers.get("warc-type") == "revisit":
            told = _headers(http).get("content-length", "")
            n = int(told) if told.isascii() and told.isdigit() else None
    if headers.get("warc-type") != "revisit":
        _check(headers, "warc-payload-digest", payload)
    return Found(start, start + end + 4, None, None, headers, payload, n, proven)


def _check(headers: dict[str, str], name: str, data: bytes) -> bool:
    """Whether there is a digest of a known kind; one that differs is damage."""
    kind, _, told = headers.get(name, "").partition(":")
    if kind.lower() != "sha1":
        return False
    if told.upper() != digest32(data):
        raise Damaged(f"{name} differs")
    return True


READ_SCHEMA = (
    "path string, start long, end long, inner_start long, inner_end long, gap_reason string, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in ``archives.path``, a row each.

    A gap has a ``gap_reason``, the first check that failed in it, and null for what records
    have. ``inner_start`` and ``inner_end`` are places among the unpacked bytes of the member that
    holds the row, null where it is no part of one. An empty archive gives no row; a missing one fails the job. Payloads are null where
    ``with_payload`` is false, and for revisits.
    """
    small_batches(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in READ_SCHEMA.split(", "))])
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                place, name = fs.FileSystem.from_uri(path)
                with place.open_input_file(name) as file:
                    for x in scan(Source(file, file.size())):
                        rows.append(_row(path, x, with_payload))
                        held += len(x.payload) if with_payload else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    n = min(20_000, max(1, archives.count()))  # a task per archive; adaptive merging would see tiny rows
    return archives.select("path").repartition(n).mapInArrow(read, READ_SCHEMA)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _row(path: str, x: Found, with_payload: bool) -> dict:
    h = x.headers
    digest = h.get("warc-payload-digest")
    return {
        "path": path,
        "start": x.start,
        "end": x.end,
        "inner_start": x.inner and x.inner[0],
        "inner_end": x.inner and x.inner[1],
        "gap_reason": x.reason,
        "record_type": h.get("warc-type"),
        "record_id": h.get("warc-record-id"),
        "refers_to": h.get("warc-refers-to"),
        "target_uri": h.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] if digest else None,
        "payload_bytes": x.payload_bytes,
        "payload": x.payload if with_payload and h.get("warc-type") != "revisit" and not x.reason else None,
    }


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write ``pages`` and read them back: page id, payload size and digest, type, refers_to."""
    records = read_archives(write_archives(pages, folder, id_col, **columns), with_payload=False)
    kind = pages.schema[id_col].dataType.simpleString()
    number = lambda c: F.nullif(F.regexp_extract(c, f"^<{PAGE_URN}(.*)>$", 1), F.lit("")).cast(kind)
    return records.filter("gap_reason IS NULL").select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
