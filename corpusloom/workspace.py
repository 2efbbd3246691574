"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured rows times a row's width stay below this.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset and everything runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Tables:
    """Parquet tables of one run: they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


@contextmanager
def released(spark: SparkSession):
    """Shuffle files of a table written within go as soon as it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small(df: DataFrame, width: int) -> DataFrame:
    """df (a kept table), marked for broadcast if its measured size allows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def numbered(tables: Tables, df: DataFrame, order: list[str], name: str, number: str = "ordinal") -> DataFrame:
    """df with its place (from 0) in the order of these columns, without a single task that sorts everything.

    Rows are parted by range and sorted within; a second pass adds the rows of the ranges before.  Rows that tie in
    all order columns get places in no set order.
    """
    pid, seq = "__part", "__seq"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = tables.keep(sorted_.withColumns({pid: F.spark_partition_id(), seq: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    counts = sorted((r[pid], r["n"]) for r in kept.groupBy(pid).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = tables.spark.createDataFrame(starts or [(0, 0)], f"{pid} int, __start long")
    return kept.join(F.broadcast(offsets), pid).withColumn(number, F.col("__start") + F.col(seq)).drop(pid, seq, "__start")
