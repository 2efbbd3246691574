"""The registered queries of the ten operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import avi, html_content, licences, near_dedup, packing, quality, substring_dedup, token_store, tokenize, warc
from corpusloom.session import ensure_importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the line field retains, with their counts."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.label_lines(docs, model).where("keep").drop("keep")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a film for every embedding."""
    return avi.shots(avi.films(_table(spark, sf_dir, "embeddings")))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(spark, _table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated passages cut."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(spark, docs, count="words_removed")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.with_paths(_table(spark, sf_dir, "documents")))


def op7_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as segmented WARC records with chunked framing and put together again."""
    found = warc.reassemble(warc.records(warc.from_pages(_table(spark, sf_dir, "pages"))))
    number = F.regexp_extract("record_id", "page:([0-9]+)", 1).cast("long")
    return found.select(number.alias("page_id"), F.col("target_uri").alias("url"), "status", F.decode("body", "UTF-8").alias("html"))


def op9_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    model = html_content.fit(pages, _table(spark, sf_dir, "documents"))
    return html_content.extract_pages(pages, model)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_crf, op2_pack, op3_avi_shots, op4_token_store, op5_substring_dedup, op6_licences, op7_near_groups, op8_warc, op9_html_content, op10_bpe)
}

ORACLES: dict[str, str] = {
    "op8_warc": "SELECT page_id, coalesce(url, '') AS url, 'ok' AS status, coalesce(html, '') AS html FROM pages",
}
