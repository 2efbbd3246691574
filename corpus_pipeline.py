"""The corpus pipeline: quality rules, near duplicates, substrings, packing.

Each stage reads what the stage before kept, written as Parquet to the shared
folder, and all but the last return the columns of ``documents``.

In every stage: extra columns pass through all stages but the last, whatever they are called, and an empty table gives an empty
one.  Rows with a null doc_id are judged on their text, take no part in near duplicates and
substrings, and are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import near_dedup, packing, quality, substring_dedup
from corpusloom.llm.work import Workspace
from corpusloom.session import ensure_importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line field rejects.

    Null, empty and blank texts go; repeated rows are judged alike and stay; a share equal to the least stays; without ratings of both kinds every text with a word stays.
    """
    ensure_importable(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_filter(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least doc_id.

    Of rows that repeat both doc_id and text one stays; rows of a repeated doc_id with other texts count as one document and stay or go together.  Null texts stay.
    """
    ensure_importable(spark)
    return near_dedup.drop_near_duplicates(spark, docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of a smaller doc_id holds too; n_chars follows.

    A text removed as a whole becomes empty, its row stays; rows of a repeated doc_id are each cut by what their own text repeats.  Null and short texts stay as they are.
    """
    ensure_importable(spark)
    return substring_dedup.remove_repeats(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents into windows of 2048 tokens, a row for each part; null and empty texts have none."""
    ensure_importable(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("substring dedup", substrings), ("packing", pack)]

#: Neither a trained field nor online packing has an equivalent in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), str(k))
    return docs
