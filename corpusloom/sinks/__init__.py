"""Sinks: JSON lines, prompt text, Parquet, sidecars and dataset cards.  All write in parallel, one file a task, committed as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QC_COLUMNS = (
    "doc_id", "score", "n_tokens", "ascii_ratio", "repetition", "code_complexity", "parse_ok", "gopher_quality", "near_dup", "minhash_jaccard", "minhash_dup_of", "simhash_dup_of", "dup_family_id", "hamdist", "qc_lang", "qc_reason", "qc_would_drop",
)
SAFETY_COLUMNS = ("doc_id", "safety_decision", "safety_reason", "pii_detected", "toxicity", "num_emails", "num_phones", "num_ips")


def jsonl(records: DataFrame, path: str, gzip: bool = False, mode: str = "error", header: DataFrame | None = None, footer: DataFrame | None = None) -> None:
    """One compact object a line, nulls left out.  header and footer (text, meta as JSON text or structs) are files of their own beside the records: run_header sorts first."""
    records.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)
    for extra in (header, footer):
        if extra is not None:
            extra.coalesce(1).write.mode("append").option("compression", "gzip" if gzip else "none").json(path)


HEADING = "### {path} [chunk {chunk}]"


def prompts(records: DataFrame, path: str, heading: str = HEADING, mode: str = "error", ordered: bool = True) -> None:
    """Heading, text and a blank line for each record; ordered: files and rows by path and chunk (a range sort, no single task)."""
    pieces = []
    for k, part in enumerate(heading.replace("{chunk}", "\0c\0").replace("{path}", "\0p\0").split("\0")):
        if k % 2:
            pieces.append(F.coalesce((F.col("meta.path") if part == "p" else F.col("meta.chunk_id")).cast("string"), F.lit("")))
        elif part:
            pieces.append(F.lit(part))
    value = F.concat(*pieces, F.lit("\n"), F.col("text"), F.lit("\n")).alias("value")
    rows = records.orderBy("meta.path", "meta.chunk_id") if ordered else records
    rows.select(value).write.mode(mode).text(path)


def parquet(records: DataFrame, path: str, partition_by: list[str] = (), codec: str = "snappy", mode: str = "error") -> None:
    """text and meta; keys of meta in partition_by are lifted to folders."""
    lifted = records.withColumns({k: F.col(f"meta.{k}") for k in partition_by}) if partition_by else records
    w = lifted.write.mode(mode).option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def qc_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    _csv(rows, QC_COLUMNS, path, mode)


def safety_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    _csv(rows, SAFETY_COLUMNS, path, mode)


def _csv(rows: DataFrame, columns, path: str, mode: str) -> None:
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*have).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def signals(rows: DataFrame, names: list[str], path: str, form: str = "parquet", mode: str = "error") -> None:
    """Sidecar of doc_id and the signals in order of name."""
    picked = rows.select("doc_id", *sorted(names))
    w = picked.write.mode(mode)
    w.option("header", True).csv(path) if form == "csv" else w.parquet(path)
