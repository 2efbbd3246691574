"""Sum-of-squares online packing of documents into token windows.

Documents arrive in order of doc_id within a packing shard.  N(h) counts the
open windows of fill level h, kept in a level array of window + 1 entries.
A document of s tokens goes to the level h (0 opens a new window) that makes
the sum of N(h)^2 over partially filled windows least afterwards; full windows
leave the count.  A document longer than a window fills whole windows first,
only its rest is placed by the rule, so no token is cut off.

Shards hold about ``SHARD_DOCS`` documents by a hash of the id; their number
grows with the input, each is packed by one task in one pass.

Length: the column named by ``tokens``, or else max(1, (characters + 3) // 4)
of text.

Defined cases: a null or empty text has no tokens and isn't placed (no row).  A
null doc_id is packed like any other and yields null in its row.  Equal deltas
go to the fullest level (least waste), and within a level to the window that
reached it first.  Repeated rows are placed one by one; rows of equal id come
in order of length.  Columns other than doc_id, text and ``tokens`` aren't read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.work import parts

WINDOW = 2048
SHARD_DOCS = 20_000
SCHEMA = "shard int, window_id long, offset int, doc_id long, part int, part_start long, n_tokens int"


class LevelArray:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[deque] = [deque() for _ in range(window + 1)]
        self.made = 0

    def choose(self, size: int) -> int:
        """The level that makes the sum of squares least when ``size`` (1..window) more tokens go there."""
        n, w = self.count, self.window
        top = w - size
        # from h to h + size: N(h) falls by one, N(h + size) rises by one unless the window is full then
        delta = 2 * (n[size : w + 1] - n[: top + 1]) + 2
        delta[top] = 1 - 2 * n[top]
        delta[0] = 2 * n[size] + 1 if size < w else 0
        able = n[: top + 1] > 0
        able[0] = True
        delta = np.where(able, delta, np.iinfo(np.int64).max)
        return top - int(np.argmin(delta[::-1]))

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for ``size`` tokens."""
        h = self.choose(size)
        if h:
            w = self.open[h].popleft()
            self.count[h] -= 1
        else:
            w, self.made = self.made, self.made + 1
        if h + size < self.window:
            self.count[h + size] += 1
            self.open[h + size].append(w)
        return w, h

    def full(self) -> int:
        w, self.made = self.made, self.made + 1
        return w


def pack_sizes(sizes, window: int) -> list[tuple[int, int, int, int, int]]:
    """For each size in order: (index, part, window, offset, tokens) of its parts."""
    levels, out = LevelArray(window), []
    for i, size in enumerate(sizes):
        part = 0
        while size >= window:
            out.append((i, part, levels.full(), 0, window))
            part, size = part + 1, size - window
        if size > 0:
            w, at = levels.place(size)
            out.append((i, part, w, at, size))
    return out


def approx_tokens(text: str = "text"):
    """Characters over four, rounded up; null for a null or empty text."""
    n = F.length(F.col(text).cast("string"))
    return F.when(n > 0, F.floor((n + 3) / 4).cast("long"))


def pack(docs: DataFrame, window: int = WINDOW, tokens: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each part of a document: its window, offset there, and first token within the document."""
    size = F.col(tokens).cast("long") if tokens else approx_tokens()
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n")).where("n > 0")
    shards = parts(docs.count(), shard_docs)
    only = only.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], na_position="first", kind="stable")
        ids, shard = pdf["doc_id"].astype("Int64").array, int(pdf["shard"].iloc[0])
        rows = pack_sizes(pdf["n"].tolist(), window)
        at, part, win, offset, n = (np.array(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"shard": np.int32(shard), "window_id": win, "offset": offset.astype(np.int32), "doc_id": ids[at], "part": part.astype(np.int32), "part_start": part.astype(np.int64) * window, "n_tokens": n.astype(np.int32)})

    # one task a shard: left to itself, adaptive execution merges small shards into a few tasks
    return only.repartition(shards, "shard").groupBy("shard").applyInPandas(run, SCHEMA)
