"""Media columns: shots of motion-JPEG AVI files as timed clip rows.

The RIFF tree gives the frame rate (strh, or else avih) and the frames by index:
OpenDML (indx and ix chunks) first, else idx1 (offsets from the file's start or
from 'movi', told apart by looking), else a walk over movi.  Each frame is an
intra frame and decoded alone; a frame of no bytes repeats the one before.  A
shot starts at frame t where the histogram difference d(t) (half the sum of
absolute differences of two normalised luma histograms) is at least ``FLOOR``
and ``RATIO`` times the mean difference of the ``AROUND`` frames on each side,
so the threshold adapts to how lively the surroundings are.  It never rises above
``FULL``: d is 1 where two frames share no level, so shots of one or two frames are found too.

Defined cases: null or empty bytes give one row of status 'empty' with null
clip columns; bytes that aren't a readable motion-JPEG AVI, one row whose status
names the damage.  A damaged frame counts as a repeat of the one before and
makes the status of the file's clips 'damaged frames: n'; a file without any
good frame is an error row.  Ties of difference need no order.  Repeated ids
give the clips of each row.  Only the id and media columns are read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import jpeg

BINS = 32
FLOOR, RATIO, AROUND, FULL = 0.25, 3.0, 4, 0.8
SCHEMA = "media_id long, clip int, start_frame int, end_frame int, start_s double, end_s double, width int, height int, status string"


def _chunks(data: bytes, at: int, end: int):
    """(id, list type, start of body, end of body)."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        stop = min(at + 8 + size, end)
        kind = data[at + 8 : at + 12] if name in (b"LIST", b"RIFF") else b""
        yield name, kind, at + 8 + 4 * bool(kind), stop
        at += 8 + size + (size & 1)


def _fits(data: bytes, at: int, name: bytes, size: int) -> bool:
    return 0 <= at and at + 8 + size <= len(data) + 1 and data[at : at + 4] == name and struct.unpack_from("<I", data, at + 4)[0] == size


def _opendml(data: bytes, body: tuple[int, int]) -> list[tuple[int, int]]:
    """Frames of an indx chunk, which is itself a standard index or lists ix chunks."""
    a, z = body
    per, sub, kind, n = struct.unpack_from("<HBBI", data, a)
    if kind == 0:
        out = []
        for k in range(n):
            at, size, _ = struct.unpack_from("<QII", data, a + 24 + 16 * k)
            if at + 8 + 24 > len(data):
                raise jpeg.Damaged("an index points beyond the file")
            out += _opendml(data, (at + 8, at + size))
        return out
    base = struct.unpack_from("<Q", data, a + 12)[0]
    return [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", data, a + 24 + 4 * per * k) for k in range(n))]


def parse(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and each frame's bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise jpeg.Damaged("not an AVI file")
    rate, period, stream, index, legacy, movies = None, None, None, None, None, []
    for _, form, a, z in _chunks(data, 0, len(data)):
        if form not in (b"AVI ", b"AVIX"):
            continue
        for name, kind, b, y in _chunks(data, a, z):
            if kind == b"hdrl":
                number = -1
                for n2, k2, c, x in _chunks(data, b, y):
                    if n2 == b"avih":
                        period = struct.unpack_from("<I", data, c)[0]
                    if k2 != b"strl":
                        continue
                    number += 1
                    parts = {n3: (d, w) for n3, _, d, w in _chunks(data, c, x)}
                    if b"strh" in parts and stream is None and data[parts[b"strh"][0] : parts[b"strh"][0] + 4] == b"vids":
                        stream = number
                        scale, per = struct.unpack_from("<II", data, parts[b"strh"][0] + 20)
                        rate = per / scale if scale and per else None
                        index = parts.get(b"indx")
            elif kind == b"movi":
                movies.append((b, y))
            elif name == b"idx1" and legacy is None:
                legacy = (b, y)
    if stream is None or not movies:
        raise jpeg.Damaged("no video stream")
    rate = rate or (1e6 / period if period else None)
    if not rate:
        raise jpeg.Damaged("no frame rate")
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    if index:
        return rate, [data[o : o + s] for o, s in _opendml(data, index)]
    if legacy:
        rows = [(n, o, s) for n, _, o, s in struct.iter_unpack("<4sIII", data[legacy[0] : legacy[1] - (legacy[1] - legacy[0]) % 16]) if n in names]
        for base in (0, movies[0][0] - 4):
            if rows and all(_fits(data, base + o, n, s) for n, o, s in rows):
                return rate, [data[base + o + 8 : base + o + 8 + s] for _, o, s in rows]
    frames = []
    for a, z in movies:
        for name, kind, b, y in _chunks(data, a, z):
            if kind == b"rec ":
                frames += [data[c:x] for n2, _, c, x in _chunks(data, b, y) if n2 in names]
            elif name in names:
                frames.append(data[b:y])
    return rate, frames


def histogram(frame: np.ndarray) -> np.ndarray:
    return np.bincount(frame[:, :, 0].ravel() // (256 // BINS), minlength=BINS) / (frame.shape[0] * frame.shape[1])


def cuts(d: list[float]) -> list[int]:
    """Frames that start a shot; d[t] is the difference of frame t to t - 1 (d[0] isn't used)."""
    out = [0]
    for t in range(1, len(d)):
        near = d[max(1, t - AROUND) : t] + d[t + 1 : t + 1 + AROUND]
        if d[t] >= max(FLOOR, min(FULL, RATIO * (sum(near) / len(near) if near else 0.0))):
            out.append(t)
    return out


def clips(data: bytes | None) -> list[tuple]:
    """Rows of SCHEMA without the id."""
    none = (None,) * 7
    if not data:
        return [(*none, "empty")]
    try:
        rate, frames = parse(data)
        before, size, d, bad = None, None, [], 0
        for raw in frames:
            h = before
            if raw:
                try:
                    image = jpeg.decode(raw)
                    h, size = histogram(image), size or image.shape
                except (jpeg.Damaged, KeyError, IndexError, ValueError):
                    bad += 1
            d.append(0.0 if before is None or h is None else float(np.abs(h - before).sum() / 2))
            before = h
        if size is None:
            raise jpeg.Damaged("no good frame")
        starts = cuts(d)
        status = f"damaged frames: {bad}" if bad else "ok"
        return [(k, a, z, a / rate, z / rate, size[1], size[0], status) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(d)], strict=True))]
    except (jpeg.Damaged, struct.error, RecursionError) as e:
        return [(*none, f"error: {e}")]


def shots(media: DataFrame, id_column: str = "media_id", column: str = "media") -> DataFrame:
    """Clip rows of every row of media.  Few files to a batch, as files are large."""

    def run(batches):
        schema = pa.schema([("media_id", pa.int64()), *((n, pa.int32()) for n in ("clip", "start_frame", "end_frame")), ("start_s", pa.float64()), ("end_s", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("status", pa.string())])
        for b in batches:
            rows = [(i.as_py(), *r) for i, m in zip(b.column(0), b.column(1), strict=True) for r in clips(m.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    return media.select(F.col(id_column).cast("long").alias("media_id"), F.col(column).cast("binary").alias("media")).mapInArrow(run, SCHEMA)


def write(frames: list[bytes], rate: int, size: tuple[int, int], index: str = "idx1") -> bytes:
    """An AVI file of motion-JPEG frames, for tests and fixtures.  index: idx1, absolute (idx1 from the file's start), indx or none."""

    def chunk(name, body):
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    def group(kind, body):
        return chunk(b"LIST", kind + body)

    h, w = size
    avih = chunk(b"avih", struct.pack("<14I", 1_000_000 // rate, 0, 0, 16, len(frames), 0, 1, 0, w, h, 0, 0, 0, 0))
    strh = chunk(b"strh", struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0, 0, 0, w, h))
    strf = chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0))
    room = 24 + 8 * len(frames) if index == "indx" else 0
    header = 12 + len(group(b"hdrl", avih + group(b"strl", strh + strf + (chunk(b"indx", b"\0" * room) if room else b""))))
    at, places, body = header + 12, [], b""
    for f in frames:
        places.append((at, len(f)))
        c = chunk(b"00dc", f)
        body += c
        at += len(c)
    extra = b""
    if room:
        extra = chunk(b"indx", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", header, 0) + b"".join(struct.pack("<II", p + 8 - header, s) for p, s in places))
    hdrl = group(b"hdrl", avih + group(b"strl", strh + strf + extra))
    tail = b""
    if index in ("idx1", "absolute"):
        base = header + 8 if index == "idx1" else 0
        tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, p - base, s) for p, s in places))
    return chunk(b"RIFF", b"AVI " + hdrl + group(b"movi", body) + tail)


def scene(vector: list[float], label: int) -> tuple[list[np.ndarray], list[int]]:
    """Frames (16 x 16) and true shot starts of a small film drawn from an embedding: 2 to 4 shots of 3 to 5 frames; level and gradient of each shot come from its values."""
    v = [float(x) if x is not None else 0.0 for x in vector] or [0.0]
    frames, starts, level = [], [], 32
    ramp = np.add.outer(np.arange(16), np.arange(16)) / 30
    for k in range(2 + abs(int(label)) % 3):
        starts.append(len(frames))
        level = (level + 64 + int(abs(v[k % len(v)]) * 100) % 64) % 192
        for j in range(3 + int(abs(v[(k + 7) % len(v)]) * 1000) % 3):
            frames.append(np.clip(level + 40 * ramp + j, 0, 255))
    return frames, starts


def films(embeddings: DataFrame) -> DataFrame:
    """media_id, media: an AVI file for every embedding (the test tables have no media; this is the fixture that stands for a media column)."""

    def run(batches):
        for b in batches:
            out = []
            for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
                frames, _ = scene(v or [], label or 0)
                out.append(write([jpeg.encode_grey(f, tables=False) for f in frames], 25, (16, 16)))
            yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array(out, pa.binary())], ["media_id", "media"])

    return embeddings.select(F.col("vec_id").cast("long").alias("media_id"), "embedding", "label").mapInArrow(run, "media_id long, media binary")
