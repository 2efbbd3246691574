"""WARC: parsing records and reassembling segmented ones.

A record that was cut into segments (ISO 28500, section 7) is a first record
with WARC-Segment-Number 1 and continuation records that name it in
WARC-Segment-Origin-ID.  Segments are parsed once and grouped by the origin's identifier in one
shuffle (equal repeats collapse before it), ordered by number and joined; the total is verified against
WARC-Segment-Total-Length of the last one.  An HTTP response is then split at
its header and, if its Transfer-Encoding ends in chunked, its framing decoded.

Defined cases (column status): 'ok'; 'no origin' (the first segment is
missing); 'gap' (a number is missing, or the last segment is: none states a total); 'conflict' (one number, different
bytes; equal repeats collapse); 'length' (the total differs); 'bad chunk' (damaged framing);
'bad record' (bytes that are no WARC record; one row each).  Body is null unless ok.  A record without segment number
is whole.  Null payloads are empty.  Records with neither identifier are each on their own,
without one to report.  Two origins never mix: the identifier is the only key; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "record_id string, type string, target_uri string, segment_number int, origin_id string, total_length long, payload binary, damaged boolean"
PAGES = "record_id string, target_uri string, n_segments int, http_status int, status string, body binary"


def parse_record(raw: bytes) -> tuple | None:
    """Columns of RECORDS from one record's bytes, or None if damaged."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields[b"content-length"])
        if length < 0 or length > len(rest):
            return None
        number = int(n) if (n := fields.get(b"warc-segment-number")) else None
        total = int(n) if (n := fields.get(b"warc-segment-total-length")) else None
    except (KeyError, ValueError):
        return None
    return fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"), number, fields.get(b"warc-segment-origin-id"), total, rest[:length], False


def split_file(data: bytes) -> list[bytes]:
    """The records of a WARC file's (uncompressed) bytes; what can't be read to the end is the last one."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        try:
            lines = data[at:end].lower().split(b"\r\n")
            size = next(int(line.partition(b":")[2]) for line in lines if line.startswith(b"content-length:"))
        except (StopIteration, ValueError):
            out.append(data[at:])
            break
        out.append(data[at : end + 4 + size])
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2
    return out


def _inflated(f, chunk: int) -> Iterator[bytes]:
    """The bytes of a file, those of its gzip members if it has them; a damaged member ends it."""
    raw = f.read(chunk)
    member = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
    while raw:
        if member is None:
            yield raw
            raw = f.read(chunk)
            continue
        try:
            out = member.decompress(raw, 8 * chunk)
        except zlib.error:
            return
        if out:
            yield out
        if member.eof:
            raw, member = member.unused_data or f.read(chunk), zlib.decompressobj(31)
        else:
            raw = member.unconsumed_tail or f.read(chunk)


def stream_records(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file object, gzip members or plain, one by one; what can't be read to the end is the last one."""
    source, data = _inflated(f, chunk), b""

    def fill() -> bool:
        nonlocal data
        got = next(source, b"")
        data += got
        return bool(got)

    while True:
        while data[:2] in (b"\r\n", b"\r", b""):
            if data[:2] == b"\r\n":
                data = data[2:]
            elif not fill():
                if data:
                    yield data
                return
        while (end := data.find(b"\r\n\r\n")) < 0 and fill():
            pass
        try:
            size = next(int(line.partition(b":")[2]) for line in data[: max(end, 0)].lower().split(b"\r\n") if line.startswith(b"content-length:"))
            if size < 0:
                raise ValueError
        except (StopIteration, ValueError):
            while fill():
                pass
            yield data
            return
        parts = [data]  # a long record is joined once
        while sum(map(len, parts)) < end + 4 + size:
            data = b""
            if not fill():
                break
            parts.append(data)
        data = b"".join(parts)
        yield data[: end + 4 + size]
        data = data[end + 4 + size :]


def read_files(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Raw records (column record) of .warc and .warc.gz files (a file, folder or pattern): a task streams its files, so none is held whole."""
    paths = spark.read.format("binaryFile").load(path).select("path")  # contents aren't read
    n = paths.count()

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
                held, size = [], 0
                with fs.open_input_file(name) as f:
                    for r in stream_records(f):
                        held.append(r)
                        size += len(r)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return paths.repartition(max(1, n), "path").mapInArrow(run, "record binary")


def records(raw: DataFrame, column: str = "record") -> DataFrame:
    """Parsed records of a column that holds one record's bytes a row."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("segment_number", pa.int32()), ("origin_id", pa.string()), ("total_length", pa.int64()), ("payload", pa.binary()), ("damaged", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = [parse_record(x) if x else None for x in b.column(0).to_pylist()]
            rows = [r or (None,) * 7 + (True,) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, schema.types, strict=True)], schema=schema)

    return raw.select(F.col(column).cast("binary")).mapInArrow(run, RECORDS)


class BadChunk(ValueError):
    """Damaged chunked framing."""


def dechunk(body: bytes) -> bytes:
    """Decodes chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BadChunk("no chunk size")
        digits = body[at:end].partition(b";")[0].strip()
        try:
            if not digits or not all(c in b"0123456789abcdefABCDEF" for c in digits):
                raise ValueError
            size = int(digits, 16)
        except ValueError:
            raise BadChunk("no chunk size") from None
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise BadChunk("a chunk isn't ended")
        out.append(body[at : at + size])
        at += size + 2


def http_body(payload: bytes) -> tuple[int | None, bytes]:
    """Status and body of an HTTP response; other bytes are the body as they are."""
    if not payload.startswith(b"HTTP/"):
        return None, payload
    head, _, body = payload.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    code = lines[0].split(b" ")
    status = int(code[1]) if len(code) > 1 and code[1].isdigit() else None
    coding = [v.strip().lower() for n, _, v in (x.partition(b":") for x in lines[1:]) if n.strip().lower() == b"transfer-encoding"]
    if coding and coding[-1].split(b",")[-1].strip() == b"chunked":
        body = dechunk(body)
    return status, body


def _whole(segments: list[dict]) -> tuple[str, bytes]:
    """Status and joined payload of one identifier's segments in order of number; a whole record has number null."""
    if all(s["segment_number"] is None for s in segments):
        found = {s["payload"] or b"" for s in segments}
        return ("ok", found.pop()) if len(found) == 1 else ("conflict", b"")
    by: dict[int, bytes] = {}
    totals = {s["total_length"] for s in segments if s["total_length"] is not None}
    for s in segments:
        n, p = s["segment_number"] or 1, s["payload"] or b""
        if by.setdefault(n, p) != p:
            return "conflict", b""
    if 1 not in by:
        return "no origin", b""
    if sorted(by) != list(range(1, len(by) + 1)) or not totals:
        return "gap", b""
    joined = b"".join(by[n] for n in range(1, len(by) + 1))
    return ("ok", joined) if totals == {len(joined)} else ("length", b"")


def reassemble(parsed: DataFrame) -> DataFrame:
    """One row of PAGES for each origin (and one for each damaged record)."""
    own = F.coalesce("origin_id", "record_id")
    # damaged records and those without an identifier are groups of their own
    number = F.when(own.isNull() | F.col("damaged"), F.monotonically_increasing_id())
    part = F.struct("segment_number", "total_length", "payload", F.when(F.col("origin_id").isNull(), F.col("target_uri")).alias("uri"), "damaged")
    keyed = parsed.select(F.when(~F.col("damaged"), own).alias("record_id"), number.alias("number"), part.alias("part"))
    grouped = keyed.groupBy("record_id", "number").agg(F.collect_set("part").alias("segments")).select("record_id", "segments")
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("n_segments", pa.int32()), ("http_status", pa.int32()), ("status", pa.string()), ("body", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for name, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if segments[0]["damaged"]:
                    rows.append((None, None, 0, None, "bad record", None))
                    continue
                status, joined = _whole(segments)
                code = body = None
                if status == "ok":
                    try:
                        code, body = http_body(joined)
                    except BadChunk:
                        status = "bad chunk"
                uris = sorted(s["uri"] for s in segments if s["uri"] is not None)
                rows.append((name, uris[0] if uris else None, len({s["segment_number"] for s in segments}), code, status, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema.types, strict=True)], schema=schema)

    return grouped.mapInArrow(run, PAGES)


def write_records(name: str, url: str, html: bytes, segment: int, chunk: int) -> list[bytes]:
    """A response with chunked framing, cut into WARC records of at most ``segment`` payload bytes."""
    framed = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (html[i : i + chunk] for i in range(0, len(html), chunk)))
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed + b"0\r\n\r\n"
    cut = [whole[i : i + segment] for i in range(0, len(whole), segment)]
    out = []
    for n, payload in enumerate(cut, 1):
        head = ["WARC/1.1", f"WARC-Type: {'response' if n == 1 else 'continuation'}", f"WARC-Record-ID: <urn:{name}{'' if n == 1 else f':{n}'}>", f"WARC-Target-URI: {url}", f"Content-Length: {len(payload)}"]
        if len(cut) > 1:
            head.append(f"WARC-Segment-Number: {n}")
        if n > 1:
            head.append(f"WARC-Segment-Origin-ID: <urn:{name}>")
        if n == len(cut) and n > 1:
            head.append(f"WARC-Segment-Total-Length: {len(whole)}")
        out.append("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n")
    return out


def from_pages(pages: DataFrame, segment: int = 4096, chunk: int = 1000) -> DataFrame:
    """Raw records (column record) as a crawler would have written the pages: the fixture that stands for WARC files."""

    def run(batches):
        for b in batches:
            out = [r for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for r in write_records(f"page:{i}", u or "", (h or "").encode(), segment, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "record binary")
