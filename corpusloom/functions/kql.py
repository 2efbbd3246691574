"""Queries in the pipe language KQL found in Markdown: fenced or indented blocks, their titles and tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths

_OPEN = re.compile(r"\s*(`{3,}|~{3,})([A-Za-z0-9_+-]*)\s*$")
_SHUT = re.compile(r"\s*(?:`{3,}|~{3,})\s*$")
_INDENTED = re.compile(r"(?:\t| {4} *)\S")
_HEADING = re.compile(r"\s{,3}(?:#{1,6})\s+(.+?)\s*$")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.A)
_PIPED = tuple(f" {w} " for w in ("extend", "join", "mv-expand", "summarize", "union", "where")) + (" project",)
_STARTS = tuple(f"{w} " for w in ("datatable", "let", "print", "range"))
_WORDS = tuple(
    "ago bag_unpack between bin case contains count datatable distinct endswith evaluate extend has has_all has_any iff in join let limit make-series mv-expand notin order orderby parse parse_json print project project-away project-keep project-rename project-reorder range render set startswith summarize take timechart tobool todynamic toint top toscalar tostring union view where".split()
) + ("matches regex",)
_NO_TABLES = frozenset("datatable distinct evaluate extend join let limit order orderby print project range render search summarize take top union where".split())
_CATEGORIES = (("mde", "defender defenderforendpoint m365d mde"), ("sentinel", "sentinel"), ("mdi", "mdi"))


@dataclass(frozen=True)
class Query:
    text: str
    start: int
    end: int
    lang: str | None
    title: str | None
    tables: tuple[str, ...]


def probable(text: str) -> bool:
    low = text.strip().lower()
    if "|" in low and any(w in low for w in _PIPED):
        return True
    rows = (r.strip() for r in low.splitlines())
    if any(r.startswith(_STARTS) for r in rows if r and not r.startswith(("//", "--"))):
        return True
    return sum(w in low for w in _WORDS) >= 2


def without_comments(query: str) -> str:
    return "\n".join(r.partition("//")[0] for r in query.splitlines())


def tables(query: str) -> list[str]:
    """Names of the tables at the head of a query."""
    head = next((r.strip() for r in without_comments(query).splitlines() if r.strip()), "")
    if head.lower().startswith("let "):
        head = head.rpartition("=")[2].strip() if head.count("=") == 1 else head.partition("=")[2].strip() if "=" in head else head
    head = head.partition("|")[0].strip()
    low = head.lower()
    if low.startswith("union "):
        first = (_NAME.match(p.strip()) for p in head[6:].split(","))
        return sorted({m[0] for m in first if m and m[0].lower() not in _NO_TABLES})
    if low.startswith("join "):
        m = _NAME.search(head[5:])
        return [m[0]] if m else []
    found: dict[str, str] = {}
    for m in _NAME.finditer(head):
        if m[0].lower() not in _NO_TABLES:
            found.setdefault(m[0].lower(), m[0])
    return list(found.values())


def _dedent(code: str) -> str:
    rows = code.splitlines()
    if not rows:
        return ""
    least = min((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), default=0)
    return "\n".join(r[least:] if r.strip() else r for r in rows).strip("\n") + "\n"


def _title(rows: list[str], i: int) -> str | None:
    """The nearest heading at most five lines above row i."""
    for r in reversed(rows[max(0, i - 5) : i]):
        if m := _HEADING.match(r.rstrip("\n")):
            return m[1].strip()
    return None


def extract(markdown: str, least_lines: int = 2, unlabelled: bool = True, indented: bool = True, skip_inside: bool = True) -> list[Query]:
    rows = markdown.splitlines(True)
    at = [0]
    for r in rows:
        at.append(at[-1] + len(r))
    found: dict[tuple[int, int], Query] = {}
    fences: list[tuple[int, int]] = []

    def add(code: str, a: int, b: int, lang: str | None) -> None:
        found[at[a], at[b]] = Query(code, at[a], at[b], lang, _title(rows, a), tuple(tables(code)))

    i = 0
    while i < len(rows):
        m = _OPEN.match(rows[i])
        if not m:
            i += 1
            continue
        end = i + 1
        while end < len(rows) and not _SHUT.match(rows[end]):
            end += 1
        inner, stop = rows[i + 1 : end], min(end + 1, len(rows))
        fences.append((i, stop))
        code, label = _dedent("".join(inner)), m[2].lower()
        named = label in ("kql", "kusto")
        if max(1, code.count("\n")) >= least_lines and (named or unlabelled and probable(code)):
            add(code, i, stop, label if named else None)
        i = stop
    i = 0
    while indented and i < len(rows):
        end = i
        if _INDENTED.match(rows[i]):
            while end < len(rows) and (not rows[end].strip() or _INDENTED.match(rows[end])):
                end += 1
            code = _dedent("".join(rows[i:end]))
            if not (skip_inside and any(a <= i and end <= b for a, b in fences)) and probable(code) and code.count("\n") + 1 >= least_lines:
                add(code, i, end, None)
        i = max(end, i + 1)
    return list(found.values())


def probable_column(text: Column) -> Column:
    """``probable`` as a native column."""
    low = F.lower(F.trim(text))
    piped = low.contains("|") & low.rlike(r" (?:extend|join|mv-expand|summarize|union|where) | project")
    started = low.rlike(r"(?m)^[ \t]*(?:datatable|let|print|range) ")
    hits = sum((low.contains(w).cast("int") for w in _WORDS[1:]), low.contains(_WORDS[0]).cast("int"))
    return F.coalesce(piped | started | (hits >= 2), F.lit(False))


def category(path: Column) -> Column:
    """mde, sentinel, mdi or generic by the words of a path."""
    parts = F.split(F.lower(paths.slashes(path)), "[/_.-]+")
    out = None
    for name, words in _CATEGORIES:
        hit = F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words.split()]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def extract_rows(docs: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """A row for each query in Markdown files: the columns of docs with text, start, end, lang, title, tables, category, chunk_id, n_chunks."""

    @F.pandas_udf("array<struct<text:string,start:int,end:int,label:string,title:string,tables:array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": q.text, "start": q.start, "end": q.end, "label": q.lang, "title": q.title, "tables": list(q.tables)} for q in extract(t)] if t else [] for t in texts])

    marked = docs.where(paths.path_suffix(F.col(path)).isin(".md", ".mdx", ".markdown") & F.col(text).isNotNull())
    keep = [c for c in docs.columns if c != text]
    rows = marked.select(*keep, run(F.col(text)).alias("__q")).select(*keep, F.size("__q").alias("n_chunks"), F.posexplode("__q").alias("__p", "__x"))
    x = F.col("__x")
    return rows.select(*keep, x["text"].alias(text), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), F.lit("KQL").alias("kql_lang"), x["title"].alias("title"), x["tables"].alias("tables"), category(F.col(path)).alias("category"), (F.col("__p") + 1).alias("chunk_id"), "n_chunks")
