"""From settings to one lazy plan: scan, decode, chunk, build, screen, write, summarise.

Nothing runs before ``run``; the screened rows are kept once as a table, from
which the sinks and the statistics both read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import sinks
from corpusloom.functions import decode, kql, licence
from corpusloom.operators import dedup, records, screen, stats
from corpusloom.plans.config import Config, to_dict
from corpusloom.sinks import card
from corpusloom.sources import load
from corpusloom.workspace import Tables, small

Transform = Callable[[DataFrame], DataFrame]


def source_rows(spark: SparkSession, config: Config) -> DataFrame:
    """Decoded files of all sources: path, text and what decoding tells."""
    out = None
    for k, s in enumerate(config.sources):
        df = load(spark, s.kind, **s.options)
        if "content" in df.columns:
            df = decode.decode_column(df, cap=config.decode_cap)
        df = df.select(*[c for c in df.columns if c != "meta"], F.lit(s.kind).alias("source_kind"), F.lit(k).alias("__source"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("the config names no source")
    return out


def filled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column ``name``: what a row has stays, nulls and empty texts become ``value``."""
    have = F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(have, value))


def with_licences(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files whose license is missing get that of their repository (or else of their source), as headers, manifests and licence files tell it."""
    repo = F.col("repo") if "repo" in files.columns else F.lit(None)
    keyed = files.withColumn("__repo", F.concat_ws("\0", F.col("__source").cast("string"), repo.cast("string")))
    found = licence.by_repository(keyed, "__repo").where("license is not null").select(F.col("repo").alias("__repo"), F.col("license").alias("__license"))
    found = Tables(spark, "licences").keep(found, "found")
    return filled(keyed.join(small(found, 256), "__repo", "left"), "license", F.col("__license")).drop("__repo", "__license")


def record_rows(spark: SparkSession, config: Config) -> DataFrame:
    """text, meta and doc_id of all records.  More unreadable inputs than max_error_rate allows are an error."""
    files = source_rows(spark, config)
    stats.enforce_error_rate(files, F.col("text").isNull(), config.max_error_rate)
    for k, v in config.metadata.items():
        files = filled(files, k, F.lit(v))
    if config.find_licences:
        files = with_licences(spark, files)
    files = files.drop("__source")
    rows = records.from_files(files, config.chunk)
    if config.extract_kql:
        found = kql.extract_rows(files.select("path", "text"))
        found = found.withColumns({"kind": F.lit("code"), "lang": F.col("kql_lang")})
        rows = rows.select("text", "meta").unionByName(records.build(found).select("text", "meta"))
    if config.languages:
        rows = records.tag_languages(rows)
    place = F.concat_ws("#", "meta.path", "meta.chunk_id", "meta.sha256")
    return rows.select("text", "meta", place.alias("doc_id"))


def screened(spark: SparkSession, config: Config, rows: DataFrame) -> DataFrame:
    """Rows with signals and decisions; none is dropped yet."""
    if config.quality.mode != "off":
        rows = screen.quality(rows, F.col("meta.lang"), config.quality.heuristics)
        if config.quality.dedup == "near":
            rows = screen.with_duplicates(spark, rows, h=config.quality.heuristics)
        elif config.quality.dedup == "exact":
            dups = dedup.exact_duplicates(rows).select("doc_id", F.col("dup_of").isNotNull().alias("near_dup"))
            rows = rows.join(dups, "doc_id", "left")
        rows = screen.quality_decision(rows, config.quality.min_score, config.quality.drop_near_dups)
    if config.safety.mode != "off":
        rows = screen.safety_rows(rows.withColumn("__licence", F.col("meta.license")), licence="__licence", allowed=config.safety.allowed_licenses, threshold=config.safety.toxicity_threshold).drop("__licence")
    return rows


@dataclass(frozen=True)
class Result:
    records: DataFrame
    screened: DataFrame
    summary: dict
    #: path of a sink that failed -> what it said
    failures: dict = field(default_factory=dict)


def run(spark: SparkSession, config: Config, before: tuple[Transform, ...] = (), after: tuple[Transform, ...] = ()) -> Result:
    """before: changes to records ahead of screening (text, meta, doc_id); after: changes to what the screens keep (text, meta).

    A sink that fails doesn't keep the others from writing; the result tells of it.  If all sinks fail, the last error is raised.
    """
    found = record_rows(spark, config)
    for change in before:
        found = found.transform(change)
    rows = Tables(spark, "run").keep(screened(spark, config, found), "screened")
    names = [("quality", "qc_would_drop", config.quality.mode), ("safety", "safety_would_drop", config.safety.mode)]
    kept, counts = rows, {}
    for name, column, mode in names:
        if mode != "off":
            counts[name] = screen.screener_counts(kept, column, mode=mode).first().asDict()
            kept = screen.gate(kept, column, mode)
    out = kept.select("text", "meta")
    for change in after:
        out = out.transform(change)
    total = out.agg(F.count("*").alias("records"), F.coalesce(F.sum("meta.bytes"), F.lit(0)).alias("bytes"), F.count_distinct("meta.path").alias("files")).first().asDict()
    summary, failures = total | {"screeners": counts}, {}
    for s in config.sinks:
        try:
            _write(spark, out, s, to_dict(config), summary)
        except Exception as e:  # whatever a writer raises
            failures[s.options.get("path", s.kind)] = f"{type(e).__name__}: {e}"
            if len(failures) == len(config.sinks):
                raise
    return Result(out, rows, summary | {"sink_errors": len(failures)}, failures)


def _write(spark: SparkSession, out: DataFrame, sink, settings: dict, summary: dict) -> None:
    path, rest = sink.options["path"], {k: v for k, v in sink.options.items() if k != "path"}
    if sink.kind in ("jsonl", "jsonl_gz"):

        def extra(kind: str, name: str, value: dict) -> DataFrame:
            row = spark.createDataFrame([(json.dumps({"kind": kind, name: value}, default=str),)], "value string")
            return row.select(F.lit("").alias("text"), F.struct(F.lit(kind).alias("kind"), F.col("value").alias(name)).alias("meta"))

        sinks.jsonl(out, path, gzip=sink.kind == "jsonl_gz", header=extra("run_header", "config", settings), footer=extra("run_summary", "summary", summary), **rest)
    elif sink.kind == "prompts":
        sinks.prompts(out, path, **rest)
    else:
        sinks.parquet(out, path, **rest)


def dataset_card(result: Result, title: str = "Dataset") -> str:
    return card.render(card.merge(card.fragment(result.records, title)).first(), title)
