"""Near duplicates with SetSketch registers.

A document is the set of its word 3-grams (lower case, letters and digits).
Register i holds floor(1 - log_b x), truncated to 0..Q+1, of the least value x
that an exponential hash h_i gives to a member: exponentially spaced minima.
Sketches of unions are register-wise maxima (``merge``).  With b near 1 equal
registers are as likely as the Jaccard similarity, so bands of register values
find candidates, ``estimate`` maximises the joint likelihood of the register
comparisons, and candidates that it doesn't rule out are verified on the
3-grams themselves.  Groups are the connected components of verified pairs.

No candidate is dropped: in each bucket all members are compared with its
least id, and, once those pairs are joined up, members of different components
in one bucket are compared with each other; pairs inside a component need no
comparison as they can't change the groups.

Defined cases: a null doc_id or a null text is in no group and is kept.  Exact
copies (equal text, the empty one too) are one group.  A text of one or two words is one
3-gram; a text without words has no 3-grams and groups only with exact copies.
Rows that repeat a doc_id count as one document with all their texts.  Only
doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.work import Workspace, fresh, small

SHINGLE = 3
REGISTERS, ROWS = 192, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65534
THRESHOLD = 0.5
#: A pair is verified unless its estimate lies this far below the threshold (4 standard deviations).
MARGIN = 0.15

_seeds = tk.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _seeds[:REGISTERS], _seeds[REGISTERS:] | np.uint64(1)


def _register(least: np.ndarray) -> np.ndarray:
    """Registers from least 64-bit hashes, which stand for uniform numbers."""
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def sketch(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of 3-grams and registers (0 where there are none) of each row."""
    n = len(off) - 1
    g, row = tk.shingles(data, off, SHINGLE)
    have = tk.counts(row, n)
    regs = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(have)
    if len(full):
        first = np.searchsorted(row, full)
        least = np.empty((len(full), REGISTERS), np.uint64)
        for i in range(REGISTERS):
            least[:, i] = np.minimum.reduceat((g ^ _XOR[i]) * _MUL[i], first)
        regs[full] = _register(least)
    return have, regs


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    return REGISTERS * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.exp(-regs.astype(np.float64) * np.log(BASE)).sum(-1))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of rows: maximum likelihood over the counts of greater, less and equal registers."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    na, nb = cardinality(a), cardinality(b)
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        third = (hi - lo) / 3
        left = value(lo + third) > value(hi - third)
        lo, hi = np.where(left, lo, lo + third), np.where(left, hi - third, hi)
    return (lo + hi) / 2


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n, regs (REGISTERS little-endian uint16) of every document with an id and a text."""

    def run(batches):
        for b in batches:
            data, off = tk.utf8(b.column("text"))
            n, regs = [], []
            for i, j in tk.runs(off):
                have, r = sketch(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n.append(have)
                regs += [x.tobytes() for x in r]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "digest", "n", "regs"])

    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return only.mapInArrow(run, "doc_id long, digest binary, n long, regs binary")


def bands(sk: DataFrame) -> DataFrame:
    """(bucket, doc_id) for each band of each sketch."""
    width = REGISTERS // ROWS

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), "<u2").reshape(-1, width, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, width + 1, dtype=np.uint64)[None], regs.shape[:2]).copy()
            for k in range(ROWS):
                h = tk.mix(h + (regs[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), width))], ["bucket", "doc_id"])

    return sk.select("doc_id", "regs").mapInArrow(run, "bucket long, doc_id long")


def _likely(pairs: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the likelihood doesn't rule out."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
                b = b.filter(pa.array(estimate(x, y) >= threshold - MARGIN))
            yield b.select(["a", "b"])

    left = sk.select(F.col("doc_id").alias("a"), F.col("regs").alias("ra"))
    right = sk.select(F.col("doc_id").alias("b"), F.col("regs").alias("rb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def shingle_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(tk.shingles(data, np.array([0, len(data)]), SHINGLE)[0])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def _verified(ws: Workspace, name: str, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets of 3-grams reach the threshold.  Only texts in a pair are shuffled."""
    pairs = ws.table(pairs, f"{name}-likely")
    ids = ws.table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-ids")
    wanted = ws.table(texts.join(small(ids, 16), "doc_id", "left_semi"), f"{name}-texts")

    def run(batches):
        keep = lru_cache(64)(shingle_set)
        for b in batches:
            ok = [jaccard(keep(x), shingle_set(y)) >= threshold for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    left = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    # the long side's text travels once: b's text is joined first, a's when rows are already on a
    found = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")
    return ws.table(found.distinct(), f"{name}-verified")


def components(ws: Workspace, name: str, edges: DataFrame) -> DataFrame:
    """(doc_id, root): root is the least id of the component; ids without an edge are left out.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each a grouped minimum and a join, until nothing changes.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = ws.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    before, k = state(edges), 0
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        k += 1
        edges = ws.table(star, f"{name}-{k}")
        now = state(edges)
        ws.drop(f"{name}-{k - 1}")
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("root")).distinct()
    return ws.table(edges.select(F.col("a").alias("doc_id"), F.col("b").alias("root")).union(roots.select(F.col("root").alias("doc_id"), "root")).distinct(), f"{name}-roots")


def near_groups(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id (the group's least doc_id), group_size for every document in a group of two or more."""
    ws = Workspace(spark, "near")
    sk = ws.table(sketches(docs), "sketches")
    rep = ws.table(sk.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.max("n").alias("n")), "copies")
    exact = sk.select("doc_id", "digest").join(rep.where("rep < top").select("rep", "digest"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    heads = rep.where("n > 0").select(F.col("rep").alias("doc_id"), "digest")
    distinct = ws.table(sk.select("doc_id", "digest", "regs").join(heads, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("doc_id", "regs"), "heads")
    w = Window.partitionBy("bucket")
    members = bands(distinct).withColumns({"lead": F.min("doc_id").over(w), "top": F.max("doc_id").over(w)}).where("lead < top").select("bucket", "lead", "doc_id")
    members = ws.table(members, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    star = members.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    sure = _verified(ws, "star", _likely(star, distinct, threshold), texts, threshold)
    known = components(ws, "star-groups", sure)

    # buckets that hold several components: the rest of their pairs
    joined = members.join(known, "doc_id", "left").select("bucket", "lead", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    most = joined.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = ws.table(joined.join(most.select("bucket", "main"), "bucket"), "mixed")
    minor = mixed.where("root <> main").select("bucket", F.col("doc_id").alias("x"), F.col("root").alias("rx"))
    cross = minor.join(mixed, "bucket").where("root <> rx and x <> lead and doc_id <> lead").select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()
    more = _verified(ws, "cross", _likely(cross, distinct, threshold), texts, threshold)
    groups = components(ws, "groups", sure.union(more).union(exact))
    sizes = groups.groupBy("root").agg(F.count("*").alias("group_size"))
    return groups.join(sizes, "root").select("doc_id", F.col("root").alias("group_id"), "group_size")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group, that of the least doc_id; a row that repeats both doc_id and text of another goes as well."""
    ws = Workspace(spark, "near-drop")
    name = fresh(docs, "near_drop_id")
    gone = ws.table(near_groups(spark, docs, threshold).where("doc_id <> group_id").select(F.col("doc_id").alias(name)), "gone")
    kept = docs.join(small(gone, 16), docs["doc_id"].cast("long") == F.col(name), "left_anti")
    twice = ws.table(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(name)).count().where("count > 1").select(name), "twice")
    if twice.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == F.col(name)
    digest = fresh(docs, "near_drop_digest")
    once = kept.join(small(twice, 16), same, "left_semi").withColumn(digest, F.md5("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return kept.join(small(twice, 16), same, "left_anti").unionByName(once)
