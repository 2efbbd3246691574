"""Signals that position-wise loops make expensive in expressions, as one Arrow pass over the text.

``text_signals`` gives repetition, SimHash and MinHash together, so a text
crosses to Python once; ``parse_checks`` needs Python's own parsers.  Kernels work on runs of rows of about
``RUN`` bytes, so no Python loop runs per character, and memory is bounded by a run or the longest text.

``most`` bounds how many grams, tokens or shingles of a text count, as single-machine engines do; None, the
default, takes whole texts.
"""

from __future__ import annotations

import ast
import json
import random
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PRIME = 4294967311
SEED = 0x5EED5EED
RUN = 1 << 18
#: Token hashes that a worker remembers, 10 MB or so; new words come without end as a corpus grows.
KNOWN_TOKENS = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD = _LETTER.copy()
_WORD[[*range(48, 58), 95]] = True
_COMMON = frozenset(w.encode() for w in "about across also based been between could each from have here into many more most onto other over should some such than that their them then there these this those under upon used using very when where which while will with within would your".split())
_TOKENS: dict[bytes, int] = {}


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive values, by doubling."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    out, done, cur, span = None, 0, h, 1
    while True:
        if k & span:
            out = cur if out is None else out[: len(cur) - done] + np.uint64(pow(_BASE, done, 1 << 64)) * cur[done:]
            done += span
            if done == k:
                return out[:n]
        cur = cur[:-span] + np.uint64(pow(_BASE, span, 1 << 64)) * cur[span:]
        span *= 2


def repeat_counts(texts: list[str], k: int = 16, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: positions (the first ``most``) whose k characters came before, and positions; 0 of 0 below 2 k characters.

    Grams are compared by 64-bit hashes.
    """
    length = np.array([len(t) for t in texts], np.int64)
    n = np.where(length < 2 * k, 0, length - k + 1)
    n = n if most is None else np.minimum(n, most)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    g, first, out = _grams(code, k), np.cumsum(length) - length, np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(n):
        own = np.sort(g[first[i] : first[i] + n[i]])
        out[i] = np.count_nonzero(own[1:] == own[:-1])
    return out, n


def repeats(text: str, k: int = 16, most: int | None = None) -> int:
    """Positions whose k characters came before."""
    return int(repeat_counts([text], k, most)[0][0])


def repetition_rate(text: str, k: int = 16, most: int | None = None) -> float:
    again, n = repeat_counts([text], k, most)
    return float(again[0] / max(1, n[0]))


def token_hash(token: bytes) -> int:
    """Of a lower-case token; 0 is kept for tokens that don't count."""
    h = _TOKENS.get(token)
    if h is None:
        if len(_TOKENS) >= KNOWN_TOKENS:
            _TOKENS.clear()
        h = _TOKENS[token] = int.from_bytes(blake2b(token, digest_size=8).digest(), "little") if token not in _COMMON else 0
    return h


def _spans(flag: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which end at the row starts ``inner`` too."""
    edge = np.diff(flag.astype(np.int8), prepend=0, append=0)
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    cut = inner[(inner > 0) & (inner < len(flag))]
    cut = cut[flag[cut] & flag[cut - 1]]
    starts[cut], ends[cut - 1] = True, True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _token_hashes(low: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """token_hash of each span; Python sees each distinct token once (by its first 16 bytes, longer ones one by one)."""
    b = np.frombuffer(low + bytes(16), np.uint8)
    size = e - s
    head = b[s[:, None] + np.arange(16)]
    head[np.arange(16) >= size[:, None]] = 0
    pair = np.ascontiguousarray(head).view("<u8")
    key = pair[:, 0] * np.uint64(_BASE) ^ (pair[:, 1] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    made = np.array([token_hash(low[x:y]) for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)], np.uint64)
    # a key stands for one token unless two share it: then, as for long tokens, each is hashed on its own
    odd = np.flatnonzero((size > 16) | (pair != pair[first][back]).any(1))
    out = made[back]
    out[odd] = [token_hash(low[x:y]) for x, y in zip(s[odd].tolist(), e[odd].tolist(), strict=True)]
    return out


def simhashes(data: bytes, off: np.ndarray, most: int | None = None) -> np.ndarray:
    """64-bit SimHash (signed) of each row of UTF-8 bytes; 0 without tokens.

    Tokens begin at the first ASCII letter of a run of letters, digits and underscores and have four characters or more.
    """
    rows = len(off) - 1
    out = np.zeros(rows, np.int64)
    b = np.frombuffer(data, np.uint8)
    if not len(b) or most == 0:
        return out
    s, e = _spans(_WORD[b], off)
    letters = np.flatnonzero(_LETTER[b])
    s = np.concatenate([letters, [len(b)]])[np.searchsorted(letters, s)]
    good = e - s >= 4
    s, e = s[good], e[good]
    h = _token_hashes(data.lower(), s, e)
    row = np.searchsorted(off, s, "right") - 1
    row, h = row[h != 0], h[h != 0]
    if most is not None:
        keep = np.arange(len(row)) - np.searchsorted(row, row) < most
        row, h = row[keep], h[keep]
    if not len(h):
        return out
    full, first, n = np.unique(row, return_index=True, return_counts=True)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > n[:, None]
    out[full] = np.packbits(votes, axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def simhash(text: str, most: int | None = None) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return int(simhashes(raw, np.array([0, len(raw)]), most)[0])


def shingle_rows(data: bytes, off: np.ndarray, k: int = 5, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct Adler-32 sums of the byte k-grams that hold a byte above 32, in order."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, high, seen = np.ones(n, np.int32), np.full(n, k, np.int32), np.zeros(n, bool)
    for i in range(k):
        part = b[i : i + n]
        low += part
        high += (k - i) * part.astype(np.int32)
        seen |= part > 32
    if k > 22:  # below, the sums can't reach the modulus
        low %= 65521
        high %= 65521
    size = np.diff(off)
    inside = np.arange(len(b)) - np.repeat(off[:-1], size)
    last = np.repeat(size - k if most is None else np.minimum(size - k, most - 1), size)
    keep = seen & (inside <= last)[:n]
    h = (high.astype(np.uint32) << np.uint32(16) | low.astype(np.uint32))[keep]
    ends = np.concatenate([[0], np.cumsum(keep)])[np.minimum(off, n)]
    new = np.ones(len(h), bool)
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[i:j].sort()
    new[1:] = h[1:] != h[:-1]
    new[ends[:-1][ends[:-1] < len(h)]] = True
    row = np.repeat(np.arange(len(size)), np.diff(ends))
    return row[new], h[new].astype(np.uint64)


def shingle_hashes(text: str, k: int = 5, most: int | None = None) -> np.ndarray:
    """Distinct Adler-32 sums of the byte k-grams that hold a byte above 32."""
    raw = text.encode("utf-8", "surrogatepass")
    return shingle_rows(raw, np.array([0, len(raw)]), k, most)[1].astype(np.int64)


def coefficients(n: int = 128, seed: int = SEED) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME - 1), draw.randrange(0, PRIME - 1)) for _ in range(n)]


def minhashes(row: np.ndarray, shingles: np.ndarray, rows: int, n: int = 128, seed: int = SEED) -> np.ndarray:
    """Of each row: the least (a x + b) mod PRIME for each pair of coefficients; PRIME without shingles.

    x is at most 65520 << 16 | 65520, so a x + b stays below 2**64.
    """
    out = np.full((rows, n), PRIME, np.int64)
    if len(row):
        full, first = np.unique(row, return_index=True)
        p = np.uint64(PRIME)
        for i, (a, b) in enumerate(_pairs(n, seed)):
            y = shingles * np.uint64(a)
            y += np.uint64(b)
            y %= p
            out[full, i] = np.minimum.reduceat(y, first)
    return out


def minhash(shingles: np.ndarray, n: int = 128, seed: int = SEED) -> np.ndarray:
    """The signature of one set of shingles."""
    return minhashes(np.zeros(len(shingles), np.int64), np.asarray(shingles).astype(np.uint64), 1, n, seed)[0]


_known: dict[tuple[int, int], list[tuple[int, int]]] = {}


def _pairs(n: int, seed: int):
    if (n, seed) not in _known:
        _known[n, seed] = coefficients(n, seed)
    return _known[n, seed]


def band_keys(signatures: np.ndarray, rows: int = 4) -> np.ndarray:
    """FNV-1a folds of the low 32 bits of each band's values; one signature, or one a row."""
    v = np.asarray(signatures, np.int64)
    v = v.reshape(*v.shape[:-1], -1, rows) & 0xFFFFFFFF
    h = np.full(v.shape[:-1], 2166136261, np.uint64)
    for k in range(rows):
        h = (h ^ v[..., k].astype(np.uint64)) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    return h.astype(np.int64)


def text_signals(repetition: bool = True, sim: bool = True, min_hash: bool = True, k: int = 16, max_grams: int | None = None, max_tokens: int | None = None, max_shingles: int | None = None, n_perm: int = 128, shingle: int = 5):
    """A pandas function text -> struct(repeats, repetition, simhash, minhash), nulls for a null text and for what isn't asked for."""

    @F.pandas_udf("repeats long, repetition double, simhash long, minhash array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        total = len(texts)
        out = {c: np.full(total, None, object) for c in ("repeats", "repetition", "simhash", "minhash")}
        have = np.flatnonzero(texts.notna().to_numpy())
        values = texts.iloc[have].tolist()
        i = 0
        while i < len(values):
            raw, held, j = [], 0, i
            while j < len(values) and (j == i or held + len(values[j]) <= RUN):  # only a run's bytes are held
                raw.append(values[j].encode("utf-8", "surrogatepass"))
                held, j = held + len(raw[-1]), j + 1
            at, off = have[i:j], np.cumsum([0, *map(len, raw)])
            if repetition:
                again, n = repeat_counts(values[i:j], k, max_grams)
                out["repeats"][at], out["repetition"][at] = again, again / np.maximum(1, n)
            if sim or min_hash:
                data = b"".join(raw)
                if sim:
                    out["simhash"][at] = simhashes(data, off, max_tokens)
                if min_hash:
                    for p, x in zip(at, minhashes(*shingle_rows(data, off, shingle, max_shingles), j - i, n_perm), strict=True):
                        out["minhash"][p] = x
            i = j
        return pd.DataFrame({"repeats": pd.array(out["repeats"], "Int64"), "repetition": pd.array(out["repetition"], "Float64"), "simhash": pd.array(out["simhash"], "Int64"), "minhash": out["minhash"]})

    return run


def parses(text: str, lang: str) -> bool:
    """Whether Python's parsers read a text as python, json, jsonl or yaml."""
    try:
        if lang == "python":
            ast.parse(text)
        elif lang == "json":
            json.loads(text)
        elif lang == "jsonl":
            rows = [x for x in text.splitlines() if x.strip()]
            for x in rows:
                json.loads(x)
            return bool(rows)
        elif lang == "yaml":
            import yaml

            yaml.safe_load(text)
        else:
            return False
    except Exception:  # noqa: BLE001  parsers raise many kinds; each means the text isn't of the language
        return False
    return True


@F.pandas_udf(DoubleType())
def parse_checks(texts: pd.Series, langs: pd.Series) -> pd.Series:
    """1 or 0 for python, yaml, json and jsonl; 0 for others."""
    return pd.Series([float(parses(t, (g or "").strip().lower())) if t is not None else None for t, g in zip(texts, langs, strict=True)], dtype="float64")
