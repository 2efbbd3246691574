"""Tables: JSON lines, CSV, SQLite, Parquet records, event logs as XML."""

from __future__ import annotations

import hashlib
import os
import sqlite3
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.functions import paths

MAX_CHARS = 2_000_000


def jsonl(spark: SparkSession, path: str, text_field: str = "text", max_line_chars: int = MAX_CHARS, max_text_chars: int = MAX_CHARS) -> DataFrame:
    """text, meta (JSON text), path of each line that is an object with a text; other and oversized lines are left out.

    Gzip is read by its suffix.  The path is meta.path made safe, or else <file>/<hash of the line>.txt: lines of a
    file that is split over tasks have no cheap number.
    """
    rows = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.jsonl)?(?:\.gz)?$", 1).alias("stem")).where(F.length("value") <= max_line_chars)
    v = F.try_parse_json("value")
    text = F.try_variant_get(v, f"$.{text_field}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{text_field}", "variant")) == "STRING"
    found = rows.where(is_text & (F.length(text) <= max_text_chars)).withColumns({"text": text, "meta": F.try_variant_get(v, "$.meta", "string"), "__p": F.try_variant_get(v, "$.meta.path", "string")})
    fallback = F.concat("stem", F.lit("/"), F.substring(F.md5("value"), 1, 16), F.lit(".txt"))
    return found.select("text", "meta", F.when(F.col("__p").isNull(), fallback).otherwise(paths.clean_label(F.col("__p"), fallback)).alias("path"))


def csv_text(spark: SparkSession, path: str, text_column: str = "text", header: bool = True, delimiter: str | None = None, text_index: int = 0) -> DataFrame:
    """path, text of each row whose text isn't blank.  The path is that of a column path, filepath, file_path or id, else <file>:#<hash of the row>."""
    sep = delimiter or ("\t" if path.rsplit(".gz", 1)[0].endswith(".tsv") else ",")
    raw = spark.read.csv(path, header=header, sep=sep, multiLine=True, quote='"', escape='"', enforceSchema=False)
    if header:
        low = {c.strip().lower(): c for c in reversed(raw.columns)}
        if text_column.lower() not in low:
            raise ValueError(f"no column {text_column!r}; there are {', '.join(raw.columns)}")
        text = low[text_column.lower()]
        label = next((low[n] for n in "path filepath file_path id".split() if n in low), None)
    else:
        text, label = raw.columns[text_index], None
    t = F.trim(F.col(f"`{text}`"))
    own = F.concat(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), F.lit(":#"), F.substring(F.md5(F.to_json(F.struct(*[f"`{c}`" for c in raw.columns]))), 1, 12))
    name = F.coalesce(F.nullif(F.trim(F.col(f"`{label}`")), F.lit("")), own) if label else own
    return raw.where(t != "").select(name.alias("path"), t.alias("text"))


def quoted(name: str) -> str:
    if not name or "\0" in name:
        raise ValueError("not a name")
    return '"' + name.replace('"', '""') + '"'


def _check(path: str, checksum: str | None) -> None:
    if checksum:
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != checksum.lower():
                raise ValueError(f"{path} isn't the file expected")


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Format ``sqlite_rows``: a table in ranges of rowid, one task each, or the rows of a query in one task."""

    @classmethod
    def name(cls):
        return "sqlite_rows"

    def schema(self):
        return "label string, text string"

    def reader(self, schema: StructType):
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.query = options["path"], options.get("table"), options.get("query")
        self.columns, self.id, self.where = options.get("columns"), options.get("id_column"), options.get("where")
        self.parts = int(options.get("partitions", 8))

    def _open(self):
        return sqlite3.connect(f"file:{os.path.abspath(self.path)}?mode=ro&immutable=1", uri=True)

    def partitions(self):
        if not self.table:
            return [_Range(None, None)]
        with self._open() as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        step = (high - low) // self.parts + 1
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        with self._open() as db:
            if self.query:
                rows = db.execute(self.query)
            else:
                names = self.columns.split("\x1f") if self.columns else [r[1] for r in db.execute(f"PRAGMA table_info({quoted(self.table)})")]
                tests = [f"({self.where})"] if self.where else []
                if partition.low is not None:
                    tests.append(f"rowid BETWEEN {partition.low} AND {partition.high}")
                wanted = [*names, *([self.id] if self.id and self.id not in names else [])]
                rows = db.execute(f"SELECT {', '.join(map(quoted, wanted))} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else ""))
            heads = [d[0] for d in rows.description]
            texts = self.columns.split("\x1f") if self.columns else heads
            at = [heads.index(c) for c in texts]
            id_at = heads.index(self.id) if self.id else None
            for r in rows:
                kept = [s for s in (str(r[i]).strip() for i in at if r[i] is not None) if s]
                text = "\n\n".join(kept)
                if text:
                    yield (str(r[id_at]) if id_at is not None and r[id_at] is not None else hashlib.md5(text.encode()).hexdigest()[:12], text)


def sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, text_columns=None, id_column: str | None = None, where: str | None = None, label: str | None = None, sha256: str | None = None, partitions: int = 8) -> DataFrame:
    """path (label:id) and text (columns that aren't blank, joined by blank lines) of the rows of a table or query.  The file must be readable by all executors."""
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    if query and where:
        raise ValueError("where goes with a table")
    _check(path, sha256)
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": table, "query": query, "id_column": id_column, "where": where, "columns": "\x1f".join(text_columns) if text_columns else None, "partitions": str(partitions)}
    rows = spark.read.format("sqlite_rows").options(**{k: v for k, v in options.items() if v is not None}).load()
    name = label or table or os.path.basename(path)
    mark = ":" if id_column else ":#"
    return rows.select(F.concat(F.lit(name + mark), "label").alias("path"), "text")


def parquet_records(spark: SparkSession, path: str, text_column: str = "text", meta_column: str | None = "meta") -> DataFrame:
    """text, meta, path of stored records; rows without a text are left out."""
    raw = spark.read.parquet(path)
    if text_column not in raw.columns:
        raise ValueError(f"no column {text_column!r}")
    has = meta_column and meta_column in raw.columns
    meta = F.col(meta_column) if has else F.lit(None).cast("string")
    kind = dict(raw.dtypes).get(meta_column, "")
    inner = F.col(f"{meta_column}.path").cast("string") if has and kind.startswith("struct") and "path:" in kind else F.lit(None).cast("string")
    return raw.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), meta.alias("meta"), F.coalesce(inner, F.regexp_extract(F.col("_metadata.file_name"), "(.*)", 1)).alias("path"))


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def event_dict(xml: str) -> dict | None:
    """An event's System fields and Data values; repeated names give lists, nameless values go to _unnamed.  None if it doesn't parse."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    out: dict = {}
    for part in root:
        fields: dict = {}
        for x in part.iter():
            if x is part:
                continue
            name, value = _bare(x.tag), (x.text or "").strip()
            if name == "Data":
                name = x.get("Name") or "_unnamed"
            elif x.attrib:
                value = {"value": value, **x.attrib} if value else dict(x.attrib)
            if name in fields or name == "_unnamed":
                before = fields.get(name, [])
                fields[name] = [*(before if isinstance(before, list) else [before]), value]
            else:
                fields[name] = value
        out[_bare(part.tag)] = fields
    return out


def events(rows: DataFrame, column: str = "xml") -> DataFrame:
    """rows and event (JSON text, null where the XML doesn't parse)."""
    import json

    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        made = (event_dict(x) if x else None for x in xs)
        return pd.Series([None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True) for d in made])

    return rows.withColumn("event", run(F.col(column)))


def event_xml(spark: SparkSession, path: str, tag: str = "Event") -> DataFrame:
    """xml and event (JSON text) for each event of exported XML files."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))).alias("xml"))
    return events(raw)
