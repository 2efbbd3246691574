"""Dataset cards: a fragment for each output, merged and rendered as Markdown with a YAML head."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import stats


def fragment(records: DataFrame, file: str, split: str = "train") -> DataFrame:
    """One row about the records of an output: counts, bytes, languages, licences, kinds, modalities of the paths."""
    m = F.col("meta")
    ext = F.regexp_extract(F.lower(F.coalesce(m["path"], F.lit(""))), r"(\.[^./\\]+)$", 1)
    modalities = F.array_sort(F.array_distinct(F.flatten(F.collect_set(stats.modalities(F.array(ext))))))
    langs, licences = F.array_sort(F.collect_set(m["language"])), F.array_sort(F.collect_set(m["license"]))
    return records.agg(F.count("*").alias("num_examples"), F.coalesce(F.sum(m["bytes"]), F.lit(0)).alias("num_bytes"), langs.alias("language"), licences.alias("license"), F.array_sort(F.collect_set(m["kind"])).alias("kinds"), modalities.alias("modalities")).select(F.lit(file).alias("file"), F.lit(split).alias("split"), "*")


def merge(fragments: DataFrame) -> DataFrame:
    """One row: splits with their totals, unions of the lists (sorted), size category, multilinguality."""
    splits = fragments.groupBy("split").agg(F.sum("num_examples").alias("num_examples"), F.sum("num_bytes").alias("num_bytes"))
    total = splits.agg(F.array_sort(F.collect_list(F.struct("split", "num_examples", "num_bytes"))).alias("splits"), F.sum("num_examples").alias("num_examples"), F.sum("num_bytes").alias("num_bytes"))
    lists = fragments.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("language", "license", "kinds", "modalities")])
    out = total.crossJoin(lists)  # one row each
    return out.withColumns({"size_category": stats.size_bucket(F.col("num_examples")), "multilinguality": stats.multilinguality(F.col("language")), "modalities": F.when(F.size("modalities") > 0, F.col("modalities")).otherwise(F.array(F.lit("text")))})


def _scalar(v) -> str:
    s = str(v)
    plain = s and s.strip() == s and not any(c in s for c in ":#{}[],&*?|<>=!%@`\"'\\\n") and s.lower() not in ("null", "true", "false", "yes", "no", "~") and not s[0].isdigit() and s[0] != "-"
    return s if plain else json.dumps(s, ensure_ascii=False)


def yaml(data, indent: int = 0) -> str:
    """YAML of nested dicts, lists and scalars."""
    pad, out = " " * indent, []
    items = data.items() if isinstance(data, dict) else ((None, v) for v in data)
    for k, v in items:
        head = f"{pad}{k}:" if k is not None else f"{pad}-"
        if isinstance(v, dict | list):
            if v:
                inner = yaml(v, indent + 2)
                out.append(f"{head} {inner.lstrip()}" if k is None else f"{head}\n{inner}")
            else:
                out.append(f"{head} {'{}' if isinstance(v, dict) else '[]'}")
        elif v is not None:
            out.append(f"{head} {v if isinstance(v, bool | int | float) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else _scalar(v)}")
    return "\n".join(out)


def human_bytes(n: float) -> str:
    for unit in "B KB MB GB TB".split():
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PB"


def render(card, title: str = "Dataset", about: str = "") -> str:
    """Markdown of a merged card (a row of ``merge``)."""
    head = {
        "pretty_name": title,
        "language": list(card.language),
        "license": list(card.license),
        "size_categories": [card.size_category],
        "multilinguality": [card.multilinguality] if card.multilinguality else [],
        "modalities": list(card.modalities),
        "dataset_info": {"splits": [{"name": s.split, "num_bytes": s.num_bytes, "num_examples": s.num_examples} for s in card.splits], "dataset_size": card.num_bytes},
    }
    rows = [f"| {s.split} | {s.num_examples} | {human_bytes(s.num_bytes)} |" for s in card.splits]
    body = [f"# {title}", "", about or "A text corpus.", "", "## Splits", "", "| split | records | size |", "|---|---|---|", *rows, "", "## Languages", "", ", ".join(card.language) or "Not known.", "", "## Licences", "", ", ".join(card.license) or "Not known.", ""]
    return "---\n" + yaml(head) + "\n---\n\n" + "\n".join(body)
