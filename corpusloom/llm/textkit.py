"""Vectorised text primitives over Arrow string buffers.

Every function works on whole Arrow columns: bytes are classified with lookup
tables, words and lines are found with array differences, and hashes are
polynomial sums modulo 2**64, so no Python loop runs per character or word.
Nulls count as empty texts.  Working memory is bounded by splitting a batch
into row runs of about ``CHUNK`` bytes (a single longer text is its own run).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Alphanumeric ASCII and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER2 = np.zeros(256, bool)
_UPPER2[0x80:0x9F] = True
_UPPER2[0x97] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, target: int = CHUNK):
    """Row ranges (i, j) of at most ``target`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + target, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8."""
    out = _LOWER[data]
    if len(out) > 1:
        hit = np.flatnonzero((data[:-1] == 0xC3) & _UPPER2[data[1:]]) + 1
        out[hit] += 32
    return out


def spans(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a row."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    starts = np.flatnonzero(flag & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(flag & ~after) + 1


def rows_of(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, positions, "right") - 1


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _tables:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _tables.clear()
        _tables[size] = tuple(made)
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes have equal hashes wherever they lie.  Spans are in order and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
        part = data[at : ends[j - 1]]
        power, inverse = _powers(len(part))
        total = np.empty(len(part) + 1, U64)
        total[0] = 0
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (len(h)-k+1 of them; none if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc, done, cur, span = None, 0, h, 1
    while True:
        if k & span:
            acc = cur if acc is None else acc[: len(cur) - done] + U64(pow(_BASE, done, 1 << 64)) * cur[done:]
            done += span
            if done == k:
                return mix(acc[:n].copy())
        cur = cur[:-span] + U64(pow(_BASE, span, 1 << 64)) * cur[span:]
        span *= 2


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over every w consecutive values."""
    if len(x) < w:
        return x[:0]
    cur, span = x, 1
    while span * 2 <= w:
        cur = op(cur[:-span], cur[span:])
        span *= 2
    return op(cur[: len(x) - w + 1], cur[w - span : w - span + len(x) - w + 1])


def words(data: np.ndarray, off: np.ndarray, raw: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words.

    raw: words are what white space parts and case counts; otherwise they are
    lower-cased runs of letters and digits.
    """
    s, e = spans(~SPACE[data] if raw else ALNUM[data], off)
    return s, e, hash_spans(data if raw else lower(data), s, e)


def counts(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n) if len(index) else np.zeros(n, np.int64)


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams and the row of each.  A row with 1 to k-1 words has one shingle of them all."""
    s, _, h = words(data, off)
    row, n = rows_of(s, off), len(off) - 1
    have = counts(row, n)
    g = grams(h, k)
    good = row[: len(g)] == row[k - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
    g, at = g[good], row[: len(g)][good]
    short = np.flatnonzero((have > 0) & (have < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(have)])
        more = np.array([grams(h[first[r] : first[r + 1]], int(have[r]))[0] for r in short], U64)
        g, at = np.concatenate([g, more]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, at
