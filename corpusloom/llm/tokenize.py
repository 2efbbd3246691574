"""Exact byte-pair encoding in linear time, and decoding.

A text is parted by the tokenizer's pattern (GPT-2's) with a table of character
classes; each distinct part of a batch is encoded once.  Encoding takes, at each
position, the longest token that starts there, found by an Aho-Corasick pass
over the reversed part, and checks it against the token before with the
pair-compatibility rule: a pair is compatible if no merge that ranks before the
pieces' own could join across their border.  Where no token is compatible,
it backtracks to the token before and takes its next shorter prefix; a bit per
position rules out what was tried, so the work is linear (the method of the
"backtracking encoder").  The outcome is what merging in order of rank gives.

Decoding gathers bytes from one array by an offset table of the vocabulary.

Defined cases: a null text has null ids, an empty text an empty array; decoding
maps null to null and an unknown id to an error.  White space, control
characters and every Unicode text decode to what was encoded.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk

#: Path of the vocabulary (ranks, one token and its rank a line); never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct parts that a worker remembers.
MEMORY = 400_000

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    made = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            made[c] = _LETTER
        elif kind == "N":
            made[c] = _NUMBER
    made[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return made


class Vocabulary:
    """Tokens by rank, their merges, and the automaton."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.sizes = np.array(self.lengths, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.auto.add_word(t[::-1].decode("latin-1"), i)
        self.auto.make_automaton()
        self.prefix = [self._prefix(t) for t in tokens]
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self._merge(i, t)
        self._good: dict[int, bool] = {}

    def _prefix(self, t: bytes) -> int:
        """The longest token that is a shorter prefix, or -1."""
        for n in range(len(t) - 1, 0, -1):
            if (r := self.rank.get(t[:n])) is not None:
                return r
        return -1

    def _merge(self, i: int, t: bytes) -> None:
        """The last merge that makes token i, from encoding it with the tokens of lower rank."""
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and r < i and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return  # not reachable by merges
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = (self.rank[parts[0]], self.rank[parts[1]])
        self.split[i] = pair
        self.pair[pair] = i

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        key = left << 20 | right
        known = self._good.get(key)
        if known is None:
            if len(self._good) > 500_000:
                self._good.clear()
            known = self._good[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 62
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit = left
                left = self.split[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.split[left][1]
                    if left == limit:
                        return True

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one part."""
        whole = self.rank.get(piece)
        if whole is not None and self._reachable(whole):
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, t in self.auto.iter(piece[::-1].decode("latin-1")):
            if longest[~end] < 0:  # of the matches that end here the longest comes first
                longest[~end] = t
        sizes, prefix, good, compatible = self.lengths, self.prefix, self._good, self.compatible
        closed: set[int] = set()
        out: list[int] = []
        at, t, last = 0, longest[0], -1
        while at < n:
            while t >= 0:
                end = at + sizes[t]
                if end not in closed and (last < 0 or (ok := good.get(last << 20 | t)) or ok is None and compatible(last, t)):
                    break
                t = prefix[t]
            if t >= 0:
                out.append(t)
                last, at = t, end
                t = longest[at] if at < n else -1
                continue
            if not out:
                raise ValueError("the vocabulary lacks a byte of the text")
            # nothing fits here: close this place and try the token before anew, which now can't end here
            closed.add(at)
            t = out.pop()
            at -= sizes[t]
            last = out[-1] if out else -1
        return out

    def _reachable(self, i: int) -> bool:
        return len(self.tokens[i]) == 1 or self.split[i] != (i, i)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.gather(np.asarray(ids, np.int64)).tobytes()

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("unknown token id")
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.bytes[at]


@lru_cache(2)
def load(path: str = VOCABULARY) -> Vocabulary:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(sorted(ranks, key=ranks.__getitem__))


_CONTRACTIONS = {b"'s", b"'t", b"'m", b"'d", b"'re", b"'ve", b"'ll"}


def part_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which a part of the pattern starts.

    The pattern: 's 't 're 've 'm 'll 'd | one optional space and a run of
    letters, numbers, or others | white space not before a non-space | white space.
    """
    head = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    lead = b[head]
    code = lead.copy()
    two, three, four = (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    for mask, bits, more in ((two, 0x1F, 1), (three, 0x0F, 2), (four, 0x07, 3)):
        if mask.any():
            at = head[mask]
            c = b[at] & bits
            for k in range(1, more + 1):
                c = c << 6 | (b[at + k] & 0x3F)
            code[mask] = c
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    m = len(head)
    first = np.zeros(m, bool)
    first[np.searchsorted(head, off[:-1][off[:-1] < off[1:]])] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a single space before a non-space joins it; a longer run leaves its last character to what follows
    space = kind == _SPACE
    follows = np.zeros(m, bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start[np.flatnonzero(follows)] = True  # the last of a run of white space starts a part of its own
    plain = np.flatnonzero(follows & (code == 32))
    start[plain + 1] = False
    # contractions: an apostrophe that starts a part of others, and letters after it
    for a in np.flatnonzero((code == 39) & (start | np.concatenate([[True], space[:-1]]))):
        if not start[a]:
            continue  # the space before belongs to this part
        if a + 1 >= m or first[a + 1]:
            continue
        size = 0
        two_ = bytes(b[head[a] : head[a] + 2].astype(np.uint8))
        three_ = bytes(b[head[a] : head[a] + 3].astype(np.uint8))
        if two_ in _CONTRACTIONS:
            size = 1
        elif three_ in _CONTRACTIONS and a + 2 < m and not first[a + 2]:
            size = 2
        if size:
            start[a + 1 : a + 1 + size] = False
            if a + 1 + size < m:
                start[a + 1 + size] = True
    return head[start]


class BatchEncoder:
    """Encodes columns; remembers distinct parts."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = load(path)
        self.memory: dict[int, tuple[int, ...]] = {}

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and row offsets."""
        ids, ends = [], [np.zeros(1, np.int64)]
        for i, j in tk.runs(off, 2 * tk.CHUNK):
            a, b = self._run(data[off[i] : off[j]], off[i : j + 1] - off[i])
            ids.append(a)
            ends.append(b[1:] + ends[-1][-1])
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(ends)

    def _run(self, data, off):
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts = part_starts(data, off)
        ends = np.concatenate([starts[1:], [len(data)]])
        h = tk.hash_spans(data, starts, ends)
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        raw, memory, encode = data.tobytes(), self.memory, self.vocabulary.encode
        found = []
        for key, s, e in zip(keys.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True):
            ids = memory.get(key)
            if ids is None:
                ids = memory[key] = tuple(encode(raw[s:e]))
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))
        base = np.cumsum(size) - size
        n = size[inverse]
        stop = np.cumsum(n)
        at = np.arange(stop[-1]) + np.repeat(base[inverse] - (stop - n), n)
        row = np.searchsorted(starts, off, "left")
        return flat[at], np.concatenate([[0], stop])[row]


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> BatchEncoder:
    return BatchEncoder(path)


def _lists(ids: np.ndarray, ends: np.ndarray, valid: np.ndarray) -> pa.Array:
    made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
    if valid.all():
        return made
    return pa.compute.if_else(pa.array(valid), made, pa.scalar(None, made.type))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the text back, for every row."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            # a run of rows at a time: ids and the decoded copy take many times the memory of the text
            for i, j in tk.runs(tk.utf8(b.column("text"))[1]):
                yield part(enc, b.slice(i, j - i))

    def part(enc, b):
        text = b.column("text")
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        data, off = tk.utf8(text)
        ids, ends = enc.encode(data, off)
        back = enc.vocabulary.gather(ids)
        whole = np.concatenate([[0], np.cumsum(enc.vocabulary.sizes[ids])])[ends]
        same = np.array_equal(back, data) and np.array_equal(whole, off)
        ok = np.full(len(b), True) if same else np.array([np.array_equal(back[whole[i] : whole[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(b))], bool)
        n = pa.array(np.diff(ends), mask=~valid)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), n, _lists(ids, ends, valid), pa.array(ok, mask=~valid)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return only.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and token_ids.  Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        v = load(path)
        for b in batches:
            lists = b.column("token_ids")
            out = [None if x is None else v.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
