"""Statistics of signals, runs and dataset cards as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signal_stats(rows: DataFrame, signals: list[str]) -> DataFrame:
    """signal, count, mean, min, max, stdev (of the population); booleans count as 0 and 1, nulls don't count."""
    one = [F.struct(F.lit(s).alias("signal"), *[f(F.col(s).cast("double")).alias(n) for n, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max), ("stdev", F.stddev_pop))]) for s in signals]
    return rows.agg(F.array(*one).alias("a")).select(F.inline("a"))


def moments(stats: DataFrame) -> DataFrame:
    """signal, count, sum, sum_sq, min, max from reported statistics, so that shards can be added."""
    total = F.col("mean") * F.col("count")
    return stats.select("signal", "count", total.alias("sum"), ((F.col("stdev") ** 2 + F.col("mean") ** 2) * F.col("count")).alias("sum_sq"), "min", "max")


def pooled(parts: DataFrame) -> DataFrame:
    """Statistics of the union of shards from their moments."""
    n, mean = F.sum("count"), F.sum("sum") / F.sum("count")
    var = F.greatest(F.lit(0.0), F.sum("sum_sq") / n - mean * mean)
    return parts.where("count > 0").groupBy("signal").agg(n.alias("count"), mean.alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"), F.sqrt(var).alias("stdev"))


COUNTERS = ("files", "attempted_files", "bytes", "records", "sink_errors", "source_errors", "middleware_errors", "would_drop_records")


def merge_runs(runs: DataFrame, config: str | None = None) -> DataFrame:
    """One row: sums of the counters, by_ext added key by key.  With ``config`` (a column), shards of different settings are an error."""
    if config:
        kinds = runs.select(config).distinct().limit(2).collect()  # two rows at most
        if len(kinds) > 1:
            raise ValueError("shards were made with different settings")
    have = [c for c in COUNTERS if c in runs.columns]
    sums = runs.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in have])
    if "by_ext" not in runs.columns:
        return sums
    exts = runs.select(F.explode("by_ext").alias("e", "n")).groupBy("e").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n")))).alias("by_ext"))
    return sums.crossJoin(exts)  # one row each


def by_extension(files: DataFrame, ext: Column, size: Column) -> DataFrame:
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def size_bucket(n: Column) -> Column:
    """The card's size category."""
    out = None
    for low, most, name in ((0, 10**3, "n<1K"), (10**3, 10**4, "1K<n<10K"), (10**4, 10**5, "10K<n<100K"), (10**5, 10**6, "100K<n<1M"), (10**6, 10**7, "1M<n<10M"), (10**7, 10**8, "10M<n<100M"), (10**8, 10**9, "100M<n<1B")):
        hit = (n >= low) & (n < most)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(n >= 10**9, "n>1B")


def multilinguality(langs: Column) -> Column:
    n = F.size(langs)
    return F.when(n == 0, None).when(n == 1, "monolingual").otherwise("multilingual")


def shard_of(position: Column, total: Column, shards: int) -> Column:
    """Shard (from 1) of a place (from 0): contiguous parts, the first total % shards of them one longer."""
    base, extra = F.floor(total / shards), total % shards
    edge = extra * (base + 1)
    return F.when(position < edge, F.floor(position / (base + 1))).otherwise(extra + F.floor((position - edge) / F.greatest(base, F.lit(1)))).cast("long") + 1


class ErrorRate(RuntimeError):
    """Too many inputs failed."""


def enforce_error_rate(rows: DataFrame, failed: Column, most: float | None) -> None:
    """Raises ErrorRate if the share of rows for which ``failed`` holds is above ``most``; None allows all."""
    if most is None:
        return
    n = rows.agg(F.count("*").alias("all"), F.count_if(F.coalesce(failed, F.lit(False))).alias("bad")).first()
    if n["all"] and n.bad / n["all"] > most:
        raise ErrorRate(f"{n.bad} of {n['all']} inputs failed; at most {most:.2%} may")


def modalities(exts: Column) -> Column:
    """Sorted modality tags from an array of extensions (with dots); none at all counts as text."""
    groups = {"audio": (".flac", ".mp3", ".ogg", ".wav"), "image": (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tiff", ".webp"), "tabular": (".csv", ".db", ".parquet", ".sqlite", ".tsv"), "video": (".avi", ".mkv", ".mov", ".mp4", ".webm")}
    hit = [F.when(F.arrays_overlap(exts, F.array(*[F.lit(e) for e in sorted(v)])), k) for k, v in sorted(groups.items())]
    known = F.array(*[F.lit(e) for v in groups.values() for e in v])
    text = F.when((F.size(F.array_except(exts, known)) > 0) | (F.size(exts) == 0), "text")
    return F.array_sort(F.array_compact(F.array(*hit, text)))
