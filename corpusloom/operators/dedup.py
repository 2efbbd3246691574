"""Exact and near duplicates as joins: content hashes, SimHash windows, MinHash bands, and a persistent store.

Every function reads an id and a text or a signature; ``ord`` names the column
that says which of two rows comes first.  Rows with a null id or text take no part.
"""

from __future__ import annotations

import json
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.functions import signals
from corpusloom.functions import text as tx
from corpusloom.workspace import Tables, numbered, released, small

N_PERM, ROWS, THRESHOLD = 128, 4, 0.82
WINDOW, HAMMING = 128, 4
#: Rows of a bucket that are compared in one task, and the rounds in which the bands are taken.
BUCKET_ROWS, ROUNDS = 16384, 8
#: Groups of so many rows are compared as lists of so many pairs at a time, larger ones in square tiles.
SMALL_GROUP, PAIRS, TILE = 64, 16384, 1024


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, content_hash, dup_of (the first row of equal text; null for itself) and copies."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), tx.content_hash(F.col(text)).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    joined = rows.join(first, "content_hash")
    return joined.select(key, "content_hash", F.when(F.col(key) != F.col("first"), F.col("first")).alias("dup_of"), "copies")


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of least key of each text; rows without a text stay."""
    w = Window.partitionBy(F.sha2(F.encode(F.col(text), "UTF-8"), 256)).orderBy(key)
    ranked = docs.where(F.col(text).isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return ranked.unionByName(docs.where(F.col(text).isNull()))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", sim: bool = True, min_hash: bool = True, n_perm: int = N_PERM, max_tokens: int | None = None, max_shingles: int | None = None) -> DataFrame:
    """key, content_hash and the signatures asked for, in one pass over the text."""
    made = signals.text_signals(repetition=False, sim=sim, min_hash=min_hash, n_perm=n_perm, max_tokens=max_tokens, max_shingles=max_shingles)
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    out = rows.select(F.col(key), tx.content_hash(F.col(text)).alias("content_hash"), made(F.col(text)).alias("s"))
    return out.select(key, "content_hash", *(["s.simhash"] if sim else []), *(["s.minhash"] if min_hash else []))


def simhash_bands(h: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(4)])


def simhash_window(spark: SparkSession, hashes: DataFrame, key: str = "doc_id", column: str = "simhash", order: str | None = None, window: int = WINDOW, threshold: int = HAMMING) -> DataFrame:
    """key, hamdist, simhash_dup_of: the closest of the ``window`` rows before that shares a 16-bit band and differs in at most ``threshold`` bits.

    Rows are numbered in order; a band's rows are joined by blocks of ``window`` places (a row's partners lie in its own block or
    the one before), so a hot band costs window comparisons a row, not the square of its rows.  Ties go to the earlier row.
    """
    tables = Tables(spark, "simhash")
    rows = numbered(tables, hashes.select(F.col(key), F.col(column).alias("h"), *([F.col(order).alias("__o")] if order and order != key else [])), ["__o", key] if order and order != key else [key], "ordered")
    rows = tables.keep(rows.select(key, "h", "ordinal"), "numbered")
    banded = rows.select(key, "h", "ordinal", F.explode(simhash_bands(F.col("h"))).alias("b")).select(key, "h", "ordinal", "b.band", "b.value", F.floor(F.col("ordinal") / window).alias("block"))
    later = banded.select(F.col(key), "h", "ordinal", "band", "value", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    earlier = banded.select(F.col(key).alias("other"), F.col("h").alias("oh"), F.col("ordinal").alias("oo"), "band", "value", "block")
    pairs = later.join(earlier, ["band", "value", "block"]).where(F.col("oo").between(F.col("ordinal") - window, F.col("ordinal") - 1))
    close = pairs.select(key, "other", "oo", F.bit_count(F.col("h").bitwiseXOR(F.col("oh"))).alias("d")).where(F.col("d") <= threshold)
    best = close.groupBy(key).agg(F.min(F.struct("d", "oo", "other")).alias("m"))
    return best.select(key, F.col("m.d").alias("hamdist"), F.col("m.other").alias("simhash_dup_of"))


@F.pandas_udf(ArrayType(LongType()))
def _band_keys(signatures: pd.Series) -> pd.Series:
    have = np.flatnonzero(signatures.notna().to_numpy())
    out = np.full(len(signatures), None, object)
    if len(have):
        for i, keys in zip(have, signals.band_keys(np.stack(signatures.iloc[have].tolist()), ROWS), strict=True):
            out[i] = keys
    return pd.Series(out, index=signatures.index)


def bands(signatures: DataFrame, key: str, column: str = "minhash") -> DataFrame:
    """key, band, value."""
    return signatures.select(F.col(key), F.posexplode(_band_keys(F.col(column))).alias("band", "value"))


def similarity(a: Column, b: Column, n_perm: int = N_PERM) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / n_perm


def _packed(signatures: DataFrame, key: str, column: str, n_perm: int) -> DataFrame:
    """key, digest, s (the signature as bytes: the low 32 bits of each value, then a bit for 2**32) and its bands as band << 32 | value."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            v = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_perm)
            if v.min() < 0 or v.max() >> 33:
                raise ValueError("signatures must hold values from 0 to 2**33 - 1")
            raw = np.concatenate([v.astype("<u4").view(np.uint8), np.packbits((v >> 32).astype(np.uint8), axis=1)], axis=1)
            keys = signals.band_keys(v, ROWS) | np.arange(n_perm // ROWS, dtype=np.int64) << 32
            rows = [r.tobytes() for r in raw]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([blake2b(r, digest_size=16).digest() for r in rows], pa.binary()), pa.array(rows, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], [key, "digest", "s", "bands"])

    rows = signatures.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(column).alias("s"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, digest binary, s binary, bands array<bigint>")


def _equal_places(low: np.ndarray, high: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal places of each pair of rows."""
    same = low[i] == low[j]
    if high is not None:
        same &= high[i] == high[j]
    return np.count_nonzero(same, axis=1) if same.shape[1] % 8 else same.view(np.uint64).sum(1).view(np.uint8).reshape(len(i), 8).sum(1)


def _best_earlier(first: np.ndarray, lead: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the most equal places with a row of its group before ``lead`` (the first row of its key), and the first such row; -1 without one.

    first: the row at which a row's group starts.  Pairs of small groups are compared as lists, large groups in tiles.
    """
    n = len(first)
    most, where = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    width = lead - first
    starts = np.flatnonzero(first == np.arange(n))
    size = np.diff(np.append(starts, n))
    big = np.repeat(size > SMALL_GROUP, size)
    rows = np.flatnonzero(~big & (width > 0))
    ends, a = np.cumsum(width[rows]), 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - width[rows[a]] + PAIRS, "right")))
        own = rows[a:b]
        w = width[own]
        at = np.cumsum(w) - w
        i = np.repeat(own, w)
        j = np.arange(len(i)) - np.repeat(at, w) + np.repeat(first[own], w)
        score = _equal_places(low, high, i, j) * n + (n - 1 - j)  # ties to the earlier row
        top = np.maximum.reduceat(score, at)
        most[own], where[own] = top // n, n - 1 - top % n
        a = b
    for s, k in zip(starts[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        cols = np.ascontiguousarray(low[s : s + k].T)
        ups = np.ascontiguousarray(high[s : s + k].T) if high is not None else None
        for x in range(0, k, TILE):
            y = min(k, x + TILE)
            for u in range(0, y, TILE):
                v = min(y, u + TILE)
                acc = np.zeros((y - x, v - u), np.int16)
                for c in range(len(cols)):
                    same = cols[c, x:y, None] == cols[c, None, u:v]
                    if ups is not None:
                        same &= ups[c, x:y, None] == ups[c, None, u:v]
                    acc += same
                acc[s + np.arange(u, v)[None, :] >= lead[s + x : s + y, None]] = -1
                at = acc.argmax(1)
                found = acc[np.arange(y - x), at].astype(np.int64)
                better = found > most[s + x : s + y]
                most[s + x : s + y][better], where[s + x : s + y][better] = found[better], (s + u + at)[better]
    return most, where


def _best_in_buckets(entries: DataFrame, key: str, n_perm: int) -> DataFrame:
    """key, places, other: of each row (bucket, tile, key, s) the best earlier one of its bucket and tile.  Memory holds a group or an Arrow batch."""
    rows = entries.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", key)

    def found(t: pa.Table):
        bucket, tile, keys = (t.column(c).combine_chunks() for c in ("bucket", "tile", key))
        raw = np.frombuffer(b"".join(t.column("s").to_pylist()), np.uint8).reshape(len(t), -1)
        low, high = np.ascontiguousarray(raw[:, : 4 * n_perm]).view("<u4"), raw[:, 4 * n_perm :]
        high = np.unpackbits(high, axis=1, count=n_perm) if high.any() else None
        new = np.ones(len(t), bool)
        bucket, tile = bucket.to_numpy(), tile.to_numpy()
        new[1:] = (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])
        other = new.copy()
        other[1:] |= pc.not_equal(keys.slice(1), keys.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        place = np.arange(len(t))
        most, where = _best_earlier(np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(other, place, 0)), low, high)
        have = np.flatnonzero(where >= 0)
        for batch in pa.table({key: keys.take(pa.array(have)), "places": pa.array(most[have].astype(np.int32)), "other": keys.take(pa.array(where[have]))}).to_batches():
            yield batch

    def run(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            edge = np.flatnonzero((np.diff(b.column("bucket").to_numpy()) != 0) | (np.diff(b.column("tile").to_numpy()) != 0))
            last = held and (held[-1].column("bucket")[-1], held[-1].column("tile")[-1]) != (b.column("bucket")[0], b.column("tile")[0])
            cut = int(edge[-1]) + 1 if len(edge) else 0
            if held and (cut or last):
                yield from found(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from found(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    kind = entries.schema[key].dataType.simpleString()
    return rows.select("bucket", "tile", key, "s").mapInArrow(run, f"`{key}` {kind}, places int, other {kind}")


def _tiles(key: str, most: int) -> Column:
    """The tiles of a bucket that a row enters: one, or where a bucket has more than ``most`` rows, one for each pair of its parts, of ``most`` rows or so."""
    parts = F.ceil(2 * F.col("n") / most).cast("long")
    own = F.pmod(F.xxhash64(key), parts)
    split = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda q: q != own), lambda q: F.least(q, own) * parts + F.greatest(q, own))
    return F.when(F.col("n") <= most, F.array(F.lit(0).cast("long"))).otherwise(split)


def lsh_duplicates(spark: SparkSession, signatures: DataFrame, key: str = "doc_id", column: str = "minhash", threshold: float = THRESHOLD, n_perm: int = N_PERM, most: int = BUCKET_ROWS) -> DataFrame:
    """key, minhash_jaccard, minhash_of, near_dup_minhash for each row with an earlier row (smaller key) that shares a band.

    The best estimate over all such rows, ties to the smaller key.  Rows of equal signature are one row in the
    bands: a later one's best partner is the first of them, with estimate 1.  Pairs are never written: the rows of a bucket
    come together with their signatures and each keeps its best, a few bands at a time, so disk grows as the rows.
    Buckets of more than ``most`` rows are compared in tiles by several tasks.
    """
    tables = Tables(spark, "lsh")
    with released(spark):
        rows = tables.keep(_packed(signatures, key, column, n_perm), "signatures")
        firsts = rows.groupBy("digest").agg(F.min(key).alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
        copies = tables.keep(rows.select(key, "digest").join(firsts, "digest").where(F.col(key) > F.col("head")), "copies")
        heads = rows.join(small(copies.select(key, "digest").distinct(), 64), [key, "digest"], "left_anti") if copies.take(1) else rows
        heads = tables.keep(heads.select(F.monotonically_increasing_id().alias("id"), key, "s", "bands"), "heads")
        each = heads.select("id", F.explode("bands").alias("bucket"))
        shared = tables.keep(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        wanted = each.join(shared, "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "n")).alias("w"))
        work = tables.keep(heads.select("id", key, "s").join(wanted, "id").select(key, "s", "w"), "work")
        bands_, best = n_perm // ROWS, copies.select(F.col(key), F.lit(n_perm).alias("places"), F.col("head").alias("other"))
        step = -(-bands_ // ROUNDS)
        of = lambda low: lambda x: x["bucket"].between(low << 32, (low + step << 32) - 1)
        for low in range(0, bands_, step):
            entries = work.select(key, "s", F.inline(F.filter("w", of(low)))).select(key, "s", "bucket", F.explode(_tiles(key, most)).alias("tile"))
            best = best.union(tables.keep(_best_in_buckets(entries, key, n_perm), f"best{low}"))
    best = best.groupBy(key).agg(F.min(F.struct((-F.col("places")).alias("d"), "other")).alias("m"))
    j = -F.col("m.d") / n_perm
    return best.select(key, j.alias("minhash_jaccard"), F.col("m.other").alias("minhash_of"), (j >= threshold).alias("near_dup_minhash"))


def families(docs: DataFrame, sim: DataFrame, lsh: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, near_dup, dup_family_id (one hop: the MinHash partner, else the SimHash partner, else the row itself) and the partners."""
    joined = docs.select(key).join(sim, key, "left").join(lsh, key, "left")
    by_min = F.when(F.col("near_dup_minhash"), F.col("minhash_of"))
    return joined.select(
        key,
        "hamdist",
        "simhash_dup_of",
        F.coalesce("minhash_jaccard", F.lit(0.0)).alias("minhash_jaccard"),
        by_min.alias("minhash_dup_of"),
        (F.coalesce("near_dup_minhash", F.lit(False)) | F.col("hamdist").isNotNull()).alias("near_dup"),
        F.coalesce(by_min, "simhash_dup_of", key).alias("dup_family_id"),
    )


def top_families(rows: DataFrame, key: str = "doc_id", family: str = "dup_family_id", label: str | None = None, top: int = 5, examples: int = 3) -> DataFrame:
    """The ``top`` families of two or more by size, ties to the smaller id, with their first ``examples`` labels: a report."""
    name = F.col(label or key)
    sizes = rows.groupBy(family).agg(F.count("*").alias("count")).where("count >= 2").orderBy(F.desc("count"), family).limit(top)
    first = rows.join(F.broadcast(sizes), family).withColumn("__r", F.row_number().over(Window.partitionBy(family).orderBy(key))).where(F.col("__r") <= examples)  # ``top`` rows are broadcast
    return first.groupBy(family, "count").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", name.alias("v")))), lambda x: x["v"]).alias("examples")).orderBy(F.desc("count"), family)


class Store:
    """Signatures of earlier runs as Parquet tables, with the parameters they were made with.

    ``check`` looks up, ``add`` appends what the store lacks: the first row of a content hash or id wins,
    near duplicates that are no copies are stored too.  A row never matches its own id, nor what its own
    ``batch`` stored, so a batch that is run again after a failure gets the answers it got at first.
    """

    def __init__(self, spark: SparkSession, path: str, n_perm: int = N_PERM, rows: int = ROWS, threshold: float = THRESHOLD, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.params = {"n_perm": n_perm, "rows": rows, "threshold": threshold}
        found = self._params()
        if found is None:
            if read_only:
                raise FileNotFoundError(f"no store at {path}")
            spark.createDataFrame([(json.dumps(self.params, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/params")
        elif found != self.params:
            raise ValueError(f"the store was made with {found}, not {self.params}")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _params(self) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.path}/params").first()[0]) if self._exists("params") else None

    def signatures(self) -> DataFrame:
        schema = "doc_id string, content_hash string, minhash array<bigint>, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/signatures") if self._exists("signatures") else self.spark.createDataFrame([], schema)

    def add(self, rows: DataFrame, batch: str | None = None) -> int:
        """Appends rows (doc_id, content_hash, minhash) that the store lacks; how many.  batch: the name of a unit of work that may be repeated."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        tables = Tables(self.spark, "store")
        new = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash", "minhash").where("doc_id is not null and minhash is not null")
        one = new.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("content_hash"))).where("__r = 1").drop("__r")
        w = Window.partitionBy(F.coalesce("content_hash", F.concat(F.lit("id:"), "doc_id"))).orderBy("doc_id")
        one = one.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        old = self.signatures()
        fresh = one.join(old.select("doc_id"), "doc_id", "left_anti").join(old.where("content_hash is not null").select("content_hash"), "content_hash", "left_anti")
        fresh = tables.keep(fresh.select("doc_id", "content_hash", "minhash", F.lit(batch).cast("string").alias("batch")), "fresh")
        fresh.write.mode("append").parquet(f"{self.path}/signatures")
        return fresh.count()

    def check(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, global_dup, match_id, score for each row: an equal content hash scores 1, else the best estimate over shared bands.

        Rows stored under the same id, or by the same ``batch``, are no match.
        """
        tables = Tables(self.spark, "store-check")
        mine = tables.keep(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "content_hash", "minhash").where("doc_id is not null"), "mine")
        old = self.signatures()
        if batch is not None:
            old = old.where(F.col("batch").isNull() | (F.col("batch") != batch))
        held = old.select("content_hash", F.col("doc_id").alias("match_id"))  # a content hash is stored once
        copies = mine.join(held, "content_hash").where("doc_id <> match_id").select("doc_id", F.lit(1.0).alias("score"), "match_id")
        left = bands(mine.where("minhash is not null"), "doc_id")
        right = bands(old.select(F.col("doc_id").alias("match_id"), "minhash"), "match_id")
        pairs = left.join(right, ["band", "value"]).where("doc_id <> match_id").select("doc_id", "match_id").distinct()
        near = pairs.join(mine.select("doc_id", F.col("minhash").alias("a")), "doc_id").join(old.select(F.col("doc_id").alias("match_id"), F.col("minhash").alias("b")), "match_id")
        near = near.select("doc_id", similarity(F.col("a"), F.col("b"), self.params["n_perm"]).alias("score"), "match_id")
        best = copies.union(near).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("d"), "match_id")).alias("m"))
        found = mine.select("doc_id").join(best, "doc_id", "left")
        score = F.coalesce(-F.col("m.d"), F.lit(0.0))
        return found.select("doc_id", (score >= self.params["threshold"]).alias("global_dup"), F.col("m.match_id").alias("match_id"), score.alias("score"))

    def duplicates_in_store(self) -> DataFrame:
        """Content hashes stored more than once: none, if all writers used add one after the other."""
        return self.signatures().where("content_hash is not null").groupBy("content_hash").count().where("count > 1")
