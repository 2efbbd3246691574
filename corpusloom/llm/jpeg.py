"""Baseline JPEG (ITU-T T.81): decoding for motion-JPEG frames, and a greyscale encoder for tests and fixtures.

Handles 8-bit baseline and extended Huffman frames of one or three components,
any sampling factors, restart intervals, and frames without Huffman tables
(as in AVI files), which use the standard's tables.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
_ZZ = np.array(ZIGZAG)
_k = np.arange(8)
DCT = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)

# Annex K tables: counts of code lengths 1..16, then symbols
_DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
_AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9ca"
        "d2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
    ),
)


@lru_cache(64)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    code, at, out = 0, 0, {}
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits ahead: length << 8 | symbol, 0 where there is no code."""
    table = [0] * 65536
    for (length, code), symbol in _codes(counts, symbols).items():
        first = code << (16 - length)
        table[first : first + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return table


class Damaged(ValueError):
    """The bytes are no baseline JPEG."""


def _scan(data: bytes, n_mcu: int, layout: list[tuple[int, list[int], list[int]]], restart: int) -> list[list[list[int]]]:
    """Coefficients by component, in order of decoding.  layout: (component, dc table, ac table) of each block of an MCU."""
    pieces, start, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        m = data[i + 1]
        if 0xD0 <= m <= 0xD7:
            pieces.append(data[start:i])
            start = i = i + 2
        elif m == 0 or m == 0xFF:
            i += 1 + (m == 0)
        else:
            break
    pieces.append(data[start : i if i >= 0 else len(data)])
    out: dict[int, list] = {c: [] for c, _, _ in layout}
    done = 0
    for piece in pieces:
        src = piece.replace(b"\xff\x00", b"\xff") + b"\0\0\0\0"
        limit, pos, acc, have = len(src), 0, 0, 0
        dc = dict.fromkeys(out, 0)
        for _ in range(min(restart or n_mcu, n_mcu - done)):
            for c, dct, act in layout:
                block = [0] * 64
                k = 0
                table = dct
                while k < 64:
                    while have < 32:
                        if pos >= limit:
                            if pos > limit + 8:
                                raise Damaged("the scan ends early")
                            acc, have, pos = acc << 8, have + 8, pos + 1
                        else:
                            acc, have, pos = acc << 8 | src[pos], have + 8, pos + 1
                    hit = table[acc >> (have - 16) & 0xFFFF]
                    if not hit:
                        raise Damaged("no such Huffman code")
                    have -= hit >> 8
                    symbol = hit & 0xFF
                    size = symbol & 15
                    if k:
                        run = symbol >> 4
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise Damaged("too many coefficients")
                    value = 0
                    if size:
                        have -= size
                        value = acc >> have & ((1 << size) - 1)
                        if not value >> (size - 1):
                            value -= (1 << size) - 1
                    acc &= (1 << have) - 1
                    if k:
                        block[ZIGZAG[k]] = value
                    else:
                        dc[c] = block[0] = dc[c] + value
                        table = act
                    k += 1
                out[c].append(block)
            done += 1
    if done < n_mcu:
        raise Damaged("the scan ends early")
    return [out[c] for c in sorted(out)]


def decode(data: bytes) -> np.ndarray:
    """Samples as height x width x components (Y, or Y Cb Cr), uint8."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    quant: dict[int, np.ndarray] = {}
    huff = {(0, 0): _DC_LUMA, (1, 0): _AC_LUMA, (0, 1): _DC_CHROMA, (1, 1): _AC_CHROMA}
    frame, restart, i = None, 0, 2
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise Damaged("no marker")
        m = data[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m == 0xD9:
            break
        size = int.from_bytes(data[i + 2 : i + 4])
        body, i = data[i + 4 : i + 2 + size], i + 2 + size
        if m == 0xDB:
            while len(body) >= 65:
                wide = body[0] >> 4
                n = 129 if wide else 65
                table = np.zeros(64)
                table[_ZZ] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8)
                quant[body[0] & 15], body = table, body[n:]
        elif m == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15], body = (bytes(body[1:17]), bytes(body[17 : 17 + n])), body[17 + n :]
        elif m == 0xDD:
            restart = int.from_bytes(body[:2])
        elif m in (0xC0, 0xC1):
            if body[0] != 8:
                raise Damaged("not 8 bits a sample")
            h, w, n = int.from_bytes(body[1:3]), int.from_bytes(body[3:5]), body[5]
            if not h or not w:
                raise Damaged("no size")
            frame = h, w, [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
        elif 0xC2 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
            raise Damaged("not a sequential Huffman frame")
        elif m == 0xDA:
            if frame is None:
                raise Damaged("a scan before its frame")
            h, w, parts = frame
            if body[0] != len(parts):
                raise Damaged("several scans")
            used = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            if len(parts) == 1:
                parts, hm, vm = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
            mx, my = -(-w // (8 * hm)), -(-h // (8 * vm))
            layout = []
            for c, (name, ch, cv, _) in enumerate(parts):
                t = used[name]
                layout += [(c, _lookup(*huff[0, t >> 4]), _lookup(*huff[1, t & 15]))] * (ch * cv)
            planes = []
            for (_, ch, cv, q), blocks in zip(parts, _scan(data[i:], mx * my, layout, restart), strict=True):
                b = np.array(blocks, np.float64) * quant[q]
                b = DCT.T @ b.reshape(-1, 8, 8) @ DCT + 128
                plane = b.reshape(my, mx, cv, ch, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(my * cv * 8, mx * ch * 8)
                plane = np.repeat(np.repeat(plane, vm // cv, 0), hm // ch, 1)[:h, :w]
                planes.append(np.clip(np.rint(plane), 0, 255).astype(np.uint8))
            return np.stack(planes, -1)
    raise Damaged("no scan")


_FLAT = np.full(64, 8)


@lru_cache(1)
def _writers():
    return tuple({s: (n, c) for (n, c), s in _codes(*t).items()} for t in (_DC_LUMA, _AC_LUMA))


def encode_grey(image: np.ndarray, tables: bool = True) -> bytes:
    """A greyscale frame with quantisers of 8; ``tables=False`` leaves the Huffman tables out, as AVI writers do."""
    h, w = image.shape
    hb, wb = -(-h // 8), -(-w // 8)
    padded = np.pad(image.astype(np.float64) - 128, ((0, hb * 8 - h), (0, wb * 8 - w)), mode="edge")
    blocks = padded.reshape(hb, 8, wb, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coefficients = np.rint((DCT @ blocks @ DCT.T).reshape(-1, 64) / _FLAT).astype(int)[:, _ZZ].tolist()
    dc_codes, ac_codes = _writers()
    acc, bits, before = 0, 0, 0

    def put(n, v):
        nonlocal acc, bits
        acc, bits = acc << n | v, bits + n

    def number(v, size):
        put(size, v if v > 0 else v + (1 << size) - 1)

    for block in coefficients:
        d, before = block[0] - before, block[0]
        size = abs(d).bit_length()
        put(*dc_codes[size])
        if size:
            number(d, size)
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                put(*ac_codes[0xF0])
                run -= 16
            size = abs(v).bit_length()
            put(*ac_codes[run << 4 | size])
            number(v, size)
            run = 0
        if run:
            put(*ac_codes[0])
    fill = -bits % 8
    put(fill, (1 << fill) - 1)
    scan = acc.to_bytes(bits // 8).replace(b"\xff", b"\xff\x00")

    def segment(m, body):
        return bytes([0xFF, m]) + (len(body) + 2).to_bytes(2) + body

    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(int(v) for v in _FLAT[_ZZ])) + segment(0xC0, b"\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x01\x01\x11\0")
    if tables:
        out += segment(0xC4, b"\0" + _DC_LUMA[0] + _DC_LUMA[1] + b"\x10" + _AC_LUMA[0] + _AC_LUMA[1])
    return out + segment(0xDA, b"\x01\x01\0\0\x3f\0") + scan + b"\xff\xd9"
