import random
import struct

import numpy as np
import pytest

from corpusloom.llm import avi, jpeg


def picture(seed, h=24, w=33):
    r = np.random.default_rng(seed)
    return np.clip(128 + 60 * np.sin(np.arange(h)[:, None] / 5 + seed) + 40 * np.cos(np.arange(w)[None] / 7) + r.normal(0, 4, (h, w)), 0, 255)


def test_jpeg_round_trip():
    for seed, tables in ((1, True), (2, False)):
        p = picture(seed)
        d = jpeg.decode(jpeg.encode_grey(p, tables))
        assert d.shape == (24, 33, 1)
        assert np.abs(d[:, :, 0] - p).mean() < 3


def test_jpeg_damage():
    raw = jpeg.encode_grey(picture(1))
    for bad in (b"", b"xx", raw[:40], raw[: len(raw) // 2], b"\xff\xd8\xff\xd9"):
        with pytest.raises((jpeg.Damaged, KeyError, IndexError, ValueError)):
            jpeg.decode(bad)


def flat(levels, n=6):
    return [jpeg.encode_grey(np.full((16, 16), v) + np.arange(16) / 4, tables=False) for v in levels for _ in range(n)]


@pytest.mark.parametrize("index", ["idx1", "absolute", "indx", "none"])
def test_every_index(index):
    frames = flat([20, 120, 220], 5)
    rate, found = avi.parse(avi.write(frames, 25, (16, 16), index))
    assert rate == 25 and found == frames
    rows = avi.clips(avi.write(frames, 25, (16, 16), index))
    assert [(r[1], r[2]) for r in rows] == [(0, 5), (5, 10), (10, 15)]
    assert rows[1][3:] == (0.2, 0.4, 16, 16, "ok")


def test_cuts_equal_definition():
    rng = random.Random(5)
    for _ in range(50):
        d = [rng.choice([0, 0.01, 0.1, 0.3, 0.9]) for _ in range(rng.randrange(1, 20))]
        want = [0]
        for t in range(1, len(d)):
            near = [d[k] for k in range(max(1, t - 4), min(len(d), t + 5)) if k != t]
            mean = sum(near) / len(near) if near else 0
            if d[t] >= 0.8 or (d[t] >= 0.25 and d[t] >= 3 * mean):
                want.append(t)
        assert avi.cuts(d) == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_shots(n):
    """Slide shows: every shot of n frames, whatever its neighbours do."""
    levels = [20, 220, 60, 180, 100, 240]
    rows = avi.clips(avi.write(flat(levels, n), 2, (16, 16)))
    assert [r[1] for r in rows] == [n * k for k in range(len(levels))]


def coloured(planes, sampling, restart):
    """A baseline frame of Y, Cb and Cr planes with the standard's tables, quantisers of 4 and restart markers."""
    h, w = planes[0].shape
    hm, vm = sampling
    my, mx = -(-h // (8 * vm)), -(-w // (8 * hm))
    parts = [(0, hm, vm), (1, 1, 1), (2, 1, 1)]
    codes = [{s: (n, c) for (n, c), s in jpeg._codes(*t).items()} for t in (jpeg._DC_LUMA, jpeg._AC_LUMA, jpeg._DC_CHROMA, jpeg._AC_CHROMA)]
    wide = []
    for p, (c, ch, cv) in zip(planes, parts, strict=True):
        p = p if c == 0 else p.reshape(h // vm, vm, w // hm, hm).mean((1, 3))
        wide.append(np.pad(p - 128.0, ((0, my * cv * 8 - p.shape[0]), (0, mx * ch * 8 - p.shape[1])), mode="edge"))
    pieces, bits, before = [], "", [0, 0, 0]

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        pieces.append(int(bits or "0", 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0"))
        bits = ""

    for m in range(my * mx):
        if restart and m and m % restart == 0:
            flush()
            pieces.append(bytes([0xFF, 0xD0 + (m // restart - 1) % 8]))
            before = [0, 0, 0]
        for c, ch, cv in parts:
            dc, ac = codes[2 * (c > 0)], codes[2 * (c > 0) + 1]
            for y in range(cv):
                for x in range(ch):
                    top, left = ((m // mx) * cv + y) * 8, ((m % mx) * ch + x) * 8
                    q = np.rint(jpeg.DCT @ wide[c][top : top + 8, left : left + 8] @ jpeg.DCT.T / 4).astype(int).ravel()[jpeg.ZIGZAG].tolist()
                    size, tail = number(q[0] - before[c])
                    before[c], run = q[0], 0
                    bits += format(dc[size][1], f"0{dc[size][0]}b") + tail
                    for v in q[1:]:
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            bits += format(ac[0xF0][1], f"0{ac[0xF0][0]}b")
                            run -= 16
                        size, tail = number(v)
                        n, code = ac[run << 4 | size]
                        bits += format(code, f"0{n}b") + tail
                        run = 0
                    if run:
                        bits += format(ac[0][1], f"0{ac[0][0]}b")
    flush()

    def segment(m, body):
        return bytes([0xFF, m]) + (len(body) + 2).to_bytes(2) + body

    frame = b"\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x03" + b"".join(bytes([c + 1, ch << 4 | cv, 0]) for c, ch, cv in parts)
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([4] * 64)) + segment(0xDD, restart.to_bytes(2)) + segment(0xC0, frame) + segment(0xDA, b"\x03\x01\0\x02\x11\x03\x11\0\x3f\0") + b"".join(pieces) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_sampling_and_restarts(sampling, restart):
    """Chroma at full, half and quarter rate, with and without restart markers (more than eight of them), sizes that don't fill the last unit."""
    h, w = 44, 60
    y, x = np.mgrid[:h, :w]
    planes = [128 + 70 * np.sin(x / 9) * np.cos(y / 7), 90 + x.astype(float), 200 - 2.0 * y]
    d = jpeg.decode(coloured(planes, sampling, restart))
    assert d.shape == (h, w, 3)
    for k, most in enumerate((2, 3, 3)):
        assert np.abs(d[:, :, k] - planes[k]).mean() < most


def test_colour_film_of_ordinary_size():
    """320 x 240, 4:2:0, two shots that differ in luma."""
    ramp = np.mgrid[:240, :320][1] / 8
    grey = np.full((240, 320), 128.0)
    frames = [coloured([level + ramp, grey, grey], (2, 2), 20) for level in (30, 150)]
    rows = avi.clips(avi.write([frames[0]] * 3 + [frames[1]] * 3, 30, (320, 240)))
    assert [(r[1], r[2], r[5], r[6], r[7]) for r in rows] == [(0, 3, 320, 240, "ok"), (3, 6, 320, 240, "ok")]


def test_films_find_their_shots(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(40)
    got = {}
    for r in avi.shots(avi.films(rows)).collect():
        got.setdefault(r.media_id, []).append(r.start_frame)
    hits = total = 0
    for r in rows.collect():
        _, starts = avi.scene(r.embedding, r.label)
        total += len(starts)
        hits += len(set(starts) & set(got[r.vec_id]))
        # no cut where there is none
        assert set(got[r.vec_id]) <= set(starts)
    assert hits >= 0.9 * total


def test_defined_cases(spark):
    good = avi.write(flat([20, 200], 4), 10, (16, 16))
    damaged = avi.write([*flat([20], 3), b"broken", *flat([200], 3)], 10, (16, 16))
    repeat = avi.write([flat([20], 1)[0], b"", b""], 10, (16, 16))
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"RIFFxxxx"), (5, damaged), (6, avi.write([b"bad"], 10, (16, 16))), (7, repeat), (None, good), (8, good[: len(good) // 2])]
    df = spark.createDataFrame([(i, m, "x") for i, m in rows], "media_id long, media binary, clip string")
    got = {}
    for r in avi.shots(df).collect():
        got.setdefault(r.media_id, []).append(r)
    assert len(got[1]) == 4 and len(got[None]) == 2
    assert got[2][0].status == got[3][0].status == "empty" and got[2][0].clip is None
    assert got[4][0].status.startswith("error") and got[6][0].status == "error: no good frame"
    assert got[5][0].status == "damaged frames: 1" and [r.start_frame for r in got[5]] == [0, 4]
    assert [(r.start_frame, r.end_frame) for r in got[7]] == [(0, 3)]
    assert 8 in got
    assert avi.shots(df.where("media_id > 90")).count() == 0


def test_hostile_bytes():
    good = avi.write(flat([20, 200], 2), 10, (16, 16), "indx")
    rng = random.Random(1)
    for _ in range(150):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        assert avi.clips(bytes(b))
    assert struct.calcsize("<14I") == 56
