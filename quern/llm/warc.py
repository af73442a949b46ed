"""WARC archives: a writer with revisit records, and a salvage reader.

The reader checks every record (version line, header lines, length, end marks, block digest). After a failed check
it looks for the next gzip member or version line that begins a valid record, goes on from there, and logs the
bytes between as a quarantined gap. Members are inflated in steps and their records passed on as they are complete,
so that of a cut or damaged member what was inflated before the damage is kept as well. (A version line inside a
damaged payload can begin a record of its own if all its checks hold.)

Records are written by Spark's text writer with the records' end marks as line separator, so that any Hadoop file
system and the commit protocol for lost executors are served. The writer starts a new file after as many
records of mean size as make ``file_bytes``. The reader holds one archive's bytes as stored (2 GB is the most that
Spark's source of binary files gives) and one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import columns_for, new_path, written

END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_BLANK = re.compile(rb"\r?\n\r?\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELDS = re.compile(rb"(?:[!-9;-~]++:[^\n]*+\n)*+")
GZIP = b"\x1f\x8b\x08"
_GZIP = re.compile(re.escape(GZIP))


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record without its end marks. A revisit carries the digest and size of the payload, not the payload."""
    block = _HTTP + (b"" if revisit else payload)
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else ""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", clean)] if url is not None else []),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


class Bad(Exception):
    """Why the bytes at hand are no valid record; ``end`` is where a whole but damaged record would end, ``short``
    whether more bytes might make it one."""

    def __init__(self, reason: str, end: int | None = None, short: bool = False) -> None:
        super().__init__(reason)
        self.reason, self.end, self.short = reason, end, short


def parse(data: memoryview, at: int) -> tuple[dict[str, str], int, int, int]:
    """Header fields (names in lower case), start and end of the block, and the end of the record at ``at``."""
    raw = bytes(data[at : at + 4096])
    if not (m := _VERSION.match(raw)):
        raise Bad("no version line", short=len(raw) < 16)
    end, tested = _BLANK.search(raw, m.end() - 2), m.end()
    while not end and at + len(raw) < len(data):  # a longer header, as long as its lines are header lines
        line = raw.rfind(b"\n") + 1
        if line > tested and not _FIELDS.fullmatch(raw, tested, line):
            break
        seen, tested = len(raw), max(tested, line)
        raw = bytes(data[at : at + 2 * seen])
        end = _BLANK.search(raw, max(m.end() - 2, seen - 3))
    if not end:
        raise Bad("header has no end", short=at + len(raw) >= len(data))
    fields: dict[str, str] = {}
    for line in raw[m.end() : end.start()].splitlines():
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Bad("malformed header line")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Bad("no content length")
    start = at + end.end()
    stop = start + int(size)
    if stop > len(data):
        raise Bad("block is cut off", short=True)
    if bytes(data[stop : stop + 4]) != END:
        raise Bad("no end marks after the block", short=stop + 4 > len(data))
    block = fields.get("warc-block-digest", "")
    if block.lower().startswith("sha1:") and block[5:].upper() != digest(data[start:stop]):
        raise Bad("block digest differs", stop + 4)
    return fields, start, stop, stop + 4


Event = tuple[str, int, int, object]


def salvage(data) -> Iterator[Event]:
    """("record", start, end, (fields, block)) and ("gap", start, end, reason), in order, together covering all
    bytes of an archive, plain or of gzip members. Records of a member begin where it does and end where they were
    complete, the last one with the member; of a broken member a gap follows them, which takes in the last record
    before damage (not before a cut)."""
    view = memoryview(data)
    whole = bytes(view[:3]) == GZIP or (not _VERSION.match(view[:16]) and not _VERSION.search(view[:65536]) and _next_member(view, 0) is not None)
    yield from _members(view) if whole else _plain(view)


def _plain(view: memoryview, last: bool = True) -> Iterator[Event]:
    """The events of plain bytes; where more follow them (not ``last``), ("rest", start, end, reason) ends the list
    where more bytes are wanted."""
    at, gap, reason = 0, None, ""
    while at < len(view):
        try:
            fields, start, stop, end = parse(view, at)
        except Bad as bad:
            if bad.short and not last:
                break
            if gap is None:
                gap, reason = at, bad.reason
            if bad.end is not None and (bad.end == len(view) or _VERSION.match(view, bad.end)):
                at = bad.end  # a whole record whose content is damaged
                continue
            following = _VERSION.search(view, at + 1)
            at = following.start() if following else len(view) if last else max(at + 1, len(view) - 16)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, (fields, bytes(view[start:stop]))
        at = end
    if gap is not None:
        yield "gap", gap, at, reason
    if at < len(view):
        yield "rest", at, len(view), ""


def _next_member(view: memoryview, at: int) -> int | None:
    """The next place that begins a gzip member with a version line."""
    for m in _GZIP.finditer(view, at):
        try:
            if zlib.decompressobj(31).decompress(view[m.start() : m.start() + 4096], 16).startswith(b"WARC/"):
                return m.start()
        except zlib.error:
            pass
    return None


def _inflated(view: memoryview, at: int, step: int = 1 << 16) -> Iterator[tuple[bytes, int, str]]:
    """(bytes, where its input ends, state) of the member at ``at``, piece by piece; the last state is "end" or says
    why the member is broken, others are "". Before an error all that can be inflated is passed on."""
    d = zlib.decompressobj(31)
    while at < len(view):
        piece, before = view[at : at + step], d.copy()
        try:
            out = d.decompress(piece, step)
            at += len(piece) - len(d.unconsumed_tail) - len(d.unused_data)
        except zlib.error:
            if len(piece) > 1:
                d, step = before, max(1, len(piece) // 16)  # nearer to the damage
                continue
            yield b"", at, "no valid member"
            return
        yield out, at, "end" if d.eof else ""
        if d.eof:
            return
    yield d.flush(), at, "member is cut off"


def _members(view: memoryview) -> Iterator[Event]:
    at, gap, reason = 0, None, ""
    while at < len(view):
        held, wanted, state, hurt, end, last = b"", 0, "", "", at, None
        for out, end, state in _inflated(view, at):
            held += out
            if len(held) < wanted and not state:
                continue
            rest = b""
            for kind, start, stop, x in _plain(memoryview(held), bool(state)):
                if kind == "record":
                    if gap is not None:
                        yield "gap", gap, at, reason
                        gap = None
                    if last is not None:
                        yield "record", at, end, last
                    last = x
                elif kind == "gap":
                    hurt = hurt or str(x)
                else:
                    rest = held[start:stop]
            held, wanted = rest, 2 * len(rest) + (1 << 16)
        hurt = hurt if state == "end" else state
        if state not in ("end", "member is cut off"):
            last = None  # the damage may lie in its header, which no digest covers
        if state != "end" or last is None:  # a broken member ends where the next one is found
            end = _next_member(view, end if state == "end" else at + 1) or len(view)
        if last is not None:
            yield "record", at, end, last
            if hurt:
                yield "gap", at, end, f"in part: {hurt}"
        elif gap is None:
            gap, reason = at, hurt or "empty member"
        at = end
    if gap is not None:
        yield "gap", gap, len(view), reason


def damaged(record: bytes, how: int) -> bytes:
    """A record that no check lets pass: cut in half, with a changed byte at its end, or without its version line."""
    if how % 3 == 0:
        return record[: len(record) // 2]
    return record[:-1] + bytes([record[-1] ^ 1]) if how % 3 == 1 else b"QUARANTINE" + record[8:]


def is_damaged(key, every: int) -> F.Column:
    """Whether a damaged copy stands before a page's record: one key in ``every``, by checksum."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % every == 0, F.lit(False)) if every else F.lit(False)


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 64 << 20, broadcast_rows: int = 500_000, damage: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record per page. Of equal payloads of at least ``least_bytes`` bytes the page of least id is the
    response and the others revisit it; rows that repeat that id with the same payload are responses too.

    A null text is an empty payload, null urls are left out, null ids are written as such: they revisit the least
    id of their payload, or are responses where there is none. An empty table writes no record; other columns are
    not looked at. With ``damage``, one page in so many has a damaged copy of its record before it, which the reader
    must get past (see ``damaged``). Payloads that occur again are joined by a broadcast up to ``broadcast_rows`` of them, beyond that by
    a shuffle.
    """
    raw = F.coalesce(F.encode(F.col("t"), "UTF-8"), F.lit(b""))
    rows = columns_for(pages, k=key, u=url, t=html).select("k", "u", raw.alias("t")).withColumn("d", F.sha1("t"))
    first = rows.where(F.octet_length("t") >= least_bytes).groupBy("d").agg(F.min("k").alias("f"), F.count("*").alias("n")).where("n > 1 and f is not null").select("d", "f")
    first = written(first, "first")
    few = first.count() <= broadcast_rows  # of some 50 bytes; payloads then stay where they are
    joined = rows.join(F.broadcast(first) if few else first, "d", "left").select("k", "u", "t", F.when(~F.col("k").eqNullSafe(F.col("f")), F.col("f")).alias("f"), is_damaged("k", damage).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, firsts, hurt = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for at in range(0, len(keys), 500):
                body, out = batch.column(2).slice(at, 500), []
                for k, u, t, f, b in zip(keys[at : at + 500], urls[at : at + 500], body, firsts[at : at + 500], hurt[at : at + 500], strict=True):
                    made = record(k, u, t.as_py(), f, f is not None)
                    out += [damaged(made, k), made] if b else [made]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    out = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    size = rows.agg(F.avg(F.octet_length("t") + 700)).first()[0] or 1  # a record's head has some 700 bytes
    out.write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, int(file_bytes / size))).text(path)


FOUND = "file string, start long, end long, gap string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record and per quarantined gap (``gap`` is its reason, else null) of the archives under ``path``.

    A payload is the block behind its HTTP head; its size and digest are of the bytes read, and those that the
    record names for revisits, which carry none. A response whose payload contradicts its payload digest is a gap.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    names = [x.split()[0] for x in FOUND.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)))

    def number(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    def row(file: str, kind: str, start: int, end: int, x) -> tuple:
        if kind == "gap":
            return (file, start, end, x, *[None] * 7)
        fields, block = x
        what = fields.get("warc-type")
        named = re.sub("^sha1:", "", fields.get("warc-payload-digest", ""), flags=re.I).upper() or None
        head, _, payload = block.partition(END) if block.startswith(b"HTTP/") else (b"", b"", block)
        own = (number(fields.get("warc-record-id")), fields.get("warc-target-uri"))
        if what == "revisit":
            size = fields.get("x-payload-length", "")
            return (file, start, end, None, *own, int(size) if size.isdigit() else None, named, what, number(fields.get("warc-refers-to")), None)
        found = digest(payload)
        if named and named != found:
            return (file, start, end, "payload digest differs", *[None] * 7)
        return (file, start, end, None, *own, len(payload), found, what, None, payload if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for kind, start, end, x in salvage(content.as_buffer()):
                    rows.append(row(file, kind, start, end, x))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, FOUND)


def round_trip(pages: DataFrame, damage: int = 256, key: str = "page_id", **options) -> DataFrame:
    """The records of ``pages``, written to the shared folder with some damaged copies among them and read back.

    What was read is written with its gaps, which are the log. Fails if any record is missing or any damaged copy has
    no gap.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, damage=damage, key=key, **options)
    found = written(read(spark, path, payloads=False).drop("payload"), "warc-log")
    seen = found.agg(F.count(F.when(F.col("gap").isNull(), 1)), F.count("gap")).first()
    put = columns_for(pages, k=key).agg(F.count("*"), F.count_if(is_damaged("k", damage))).first()
    if tuple(seen) != tuple(put):
        raise RuntimeError(f"{put[0]} records and {put[1]} damaged ones were written, {seen[0]} and {seen[1]} gaps read")
    return found.where(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
