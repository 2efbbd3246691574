"""Sources: each gives a DataFrame of files (path, content or text) or of ready records.

``register`` adds a source under a name; ``load`` makes one from its options and
rejects options that the source doesn't know.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, source: Callable[..., DataFrame]) -> None:
    """source(spark, **options) -> DataFrame"""
    _SOURCES[name] = source


def load(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in _SOURCES:
        raise ValueError(f"no source {kind!r}; there are {', '.join(sorted(_SOURCES))}")
    known = inspect.signature(_SOURCES[kind]).parameters
    unknown = sorted(set(options) - set(known))
    if unknown and not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        raise ValueError(f"{kind} doesn't know {', '.join(unknown)}; it takes {', '.join(list(known)[1:])}")
    return _SOURCES[kind](spark, **options)


def load_plugins(group: str = "corpusloom.sources") -> list[str]:
    """Registers the sources that installed packages offer as entry points; their names."""
    found = list(entry_points(group=group))
    for e in found:
        register(e.name, e.load())
    return sorted(e.name for e in found)


def names() -> list[str]:
    return sorted(_SOURCES)


from corpusloom.sources import archives, files, tables, web  # noqa: E402

for _name, _source in {
    "local_dir": files.local_dir,
    "glob": files.glob,
    "zip": archives.zip_files,
    "github_zip": archives.zip_files,
    "jsonl": tables.jsonl,
    "csv_text": tables.csv_text,
    "sqlite": tables.sqlite,
    "parquet_records": tables.parquet_records,
    "event_xml": tables.event_xml,
    "web_pages": web.page_links,
}.items():
    register(_name, _source)
