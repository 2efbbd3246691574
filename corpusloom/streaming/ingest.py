"""JSON lines that arrive as files, screened and deduplicated as a stream.

Exact copies are dropped within the watermark of their arrival; ``into_store``
checks each micro-batch against the signature store and appends what is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import dedup, screen

SCHEMA = "doc_id string, text string, ts timestamp"


def read(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def unique(stream: DataFrame, delay: str = "1 hour", time: str = "ts", text: str = "text") -> DataFrame:
    """The first arrival of each text within the watermark's delay."""
    hashed = stream.withWatermark(time, delay).withColumn("content_hash", tx.content_hash(F.col(text)))
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def screened(stream: DataFrame, min_score: float = screen.MIN_SCORE) -> DataFrame:
    return screen.quality_decision(screen.quality(stream), min_score)


def windowed_counts(stream: DataFrame, size: str = "1 hour", delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Rows and characters of each tumbling window; rows later than the delay don't count."""
    w = F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars")).select(F.col("window.start").alias("start"), "records", "chars")


def store_batch(df: DataFrame, store: dedup.Store, out: str, number: int, name: str) -> None:
    """Writes the rows of a batch that the store doesn't know to ``out/batch=number``, and their signatures to the store under ``name``.

    Signatures that an earlier, failed run of the same batch stored are no match, so the batch is written again whole.
    """
    rows = dedup.Tables(df.sparkSession, "stream").keep(df.where("doc_id is not null and text is not null"), "rows")
    sk = dedup.sketches(rows, sim=False)
    known = store.check(sk, name).where("global_dup").select("doc_id")
    new = rows.join(known, "doc_id", "left_anti")
    dedup.drop_exact(new).write.mode("overwrite").parquet(f"{out}/batch={number}")
    store.add(sk, name)


def into_store(stream: DataFrame, store: dedup.Store, out: str, checkpoint: str, trigger: dict | None = None):
    """A started query that writes rows the store doesn't know to ``out`` and their signatures to the store, batch by batch (see store_batch)."""

    def batch(df: DataFrame, number: int) -> None:
        store_batch(df, store, out, number, f"{checkpoint}#{number}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
