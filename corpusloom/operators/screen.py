"""Screening: quality rows, decisions by mode, gates, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import safety, score, signals
from corpusloom.functions import text as tx
from corpusloom.operators import dedup

MODES = tuple("advisory inline off post".split())
MIN_SCORE = 60.0


def quality(docs: DataFrame, lang: Column | None = None, h: score.Heuristics = score.Heuristics(), text: str = "text", parse: bool = False, perplexity: str | None = None) -> DataFrame:
    """docs and the quality signals, before duplicates: n_tokens, ratios, parse_ok, gopher_quality, score (0 to 100).

    The text goes to Python once, for repetition; all else is native.  parse: also checks python, yaml, json and jsonl.
    perplexity: a column of a language model's perplexities, where one was computed.
    """
    t = F.col(text)
    label = F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("Text")) if lang is not None else F.lit("Text")
    rep = signals.text_signals(sim=False, min_hash=False, k=h.repetition_k, max_grams=h.repetition_max_grams)
    out = tx.bound(docs.withColumn("__rep", rep(t)), text)
    n = tx.qc_tokens(t)
    parsed = signals.parse_checks(t, label) if parse else None
    out = out.withColumns(
        {
            "qc_lang": label,
            "n_tokens": n,
            "length_ok": score.length_ok(n, label, h),
            "ascii_ratio": tx.ascii_ratio(t),
            "repetition": F.col("__rep.repetition"),
            "code_complexity": tx.code_complexity(t, h.code_short_line, h.code_punct_weight, h.code_short_weight, F.col("__lines")),
            "parse_ok": score.parse_ok(t, label, parsed, h),
            "gopher_quality": tx.gopher_score(t, True) if h.gopher else F.lit(1.0),
        }
    ).drop("__rep", *tx.BOUND)
    base = score.base_score(*(F.col(c) for c in ("length_ok", "repetition", "code_complexity", "ascii_ratio", "parse_ok")), score.lm_score(F.col(perplexity) if perplexity else None), F.col("gopher_quality"), h)
    return out.withColumn("score", 100 * base)


def with_duplicates(spark: SparkSession, rows: DataFrame, key: str = "doc_id", text: str = "text", h: score.Heuristics = score.Heuristics()) -> DataFrame:
    """Quality rows with near duplicates found and penalised."""
    sk = dedup.Tables(spark, "screen").keep(dedup.sketches(rows, key, text, max_tokens=h.simhash_max_tokens, max_shingles=h.minhash_max_shingles), "sketches")
    fam = dedup.families(rows, dedup.simhash_window(spark, sk, key), dedup.lsh_duplicates(spark, sk, key), key)
    joined = rows.join(fam, key, "left")
    factor = score.dup_penalty(F.col("qc_lang"), F.coalesce("near_dup", F.lit(False)), F.coalesce("hamdist", F.lit(99)))
    return joined.withColumn("score", F.col("score") * factor)


def quality_decision(rows: DataFrame, min_score: float | None = MIN_SCORE, drop_near_dups: bool = False) -> DataFrame:
    """Adds qc_reason (low_score, near_dup or null) and qc_would_drop."""
    low = F.coalesce(F.col("score") < min_score, F.lit(False)) if min_score is not None else F.lit(False)
    near = F.coalesce("near_dup", F.lit(False)) if "near_dup" in rows.columns else F.lit(False)
    would = low | near if drop_near_dups else low
    return rows.withColumns({"qc_reason": F.when(low, "low_score").when(near, "near_dup"), "qc_would_drop": would})


def safety_rows(docs: DataFrame, text: str = "text", licence: str | None = None, allowed=None, threshold: float | None = None) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    found = safety.counts(t)
    rows = docs.withColumns(found).withColumns(safety.screen(t, F.col(licence) if licence else None, allowed, threshold=threshold, have_counts=True)).drop(*found)
    return rows.withColumn("safety_would_drop", F.col("safety_decision") == "drop")


def gate(rows: DataFrame, would_drop: str, mode: str) -> DataFrame:
    """inline drops; advisory and post keep and note; off leaves the rows as they are."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return rows.where(~F.coalesce(would_drop, F.lit(False))) if mode == "inline" else rows


def screener_counts(rows: DataFrame, would_drop: str, by: list[str] = (), mode: str = "inline", value: str | None = None) -> DataFrame:
    """scored, kept, dropped, would_drop by group; only inline mode drops."""
    gone = F.count_if(F.col(would_drop))
    dropped = gone if mode == "inline" else F.lit(0).cast("long")
    extra = [F.avg(value).alias(f"avg_{value}")] if value else []
    return rows.groupBy(*by).agg(F.count("*").alias("scored"), (F.count("*") - dropped).alias("kept"), dropped.alias("dropped"), gone.alias("would_drop"), *extra)


def chain(rows: DataFrame, screens: list[tuple[str, str]]) -> DataFrame:
    """dropped_by: the first screener (name, would_drop column) in order that drops a row; later ones don't see it."""
    first = F.coalesce(*[F.when(F.col(c), n) for n, c in screens], F.lit(None).cast("string"))
    return rows.withColumn("dropped_by", first)


def chain_counts(rows: DataFrame, screens: list[tuple[str, str]]) -> DataFrame:
    """screener, scored, kept, dropped.  A row kept by one and dropped by the next counts as kept in the first."""
    seen, aggs = F.lit(True), []
    for n, c in screens:
        gone = F.coalesce(c, F.lit(False))
        aggs.append(F.struct(F.lit(n).alias("screener"), F.count_if(seen).alias("scored"), F.count_if(seen & ~gone).alias("kept"), F.count_if(seen & gone).alias("dropped")))
        seen = seen & ~gone
    return rows.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def merge_counts(parts: DataFrame) -> DataFrame:
    """Screener counts of shards (screener, scored, kept, dropped, ...), added up."""
    return parts.groupBy("screener").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in parts.columns if c != "screener"])
