"""Records: text and typed metadata, built from chunks, and the summary rows that travel with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import chunk as ck
from corpusloom.functions import paths
from corpusloom.functions import text as tx

SCHEMA_VERSION = "2"
SUMMARY_KINDS = ("qc_summary", "run_header", "run_summary")
_FALLBACK = ("cp1252", "iso-8859-1", "latin-1")
META = tuple(
    "kind source repo path url source_domain license lang lang_score language chunk_id n_chunks encoding had_replacement decoding_fallback_used "
    "sha256 approx_tokens tokens bytes file_bytes truncated_bytes nlines file_nlines schema_version".split()
)


def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds kind, lang (display name), mode and fmt for the chunker, from the path alone."""
    p = F.col(path)
    guess, kind = paths.lang_hint(p), paths.path_kind(p)
    fmt = F.when(kind["hint"] == "rst", "restructuredtext").otherwise("markdown")
    return files.withColumns({"kind": guess["kind"], "lang": paths.display_lang(guess["lang"]), "mode": kind["kind"], "fmt": fmt})


def build(chunks: DataFrame, text: str = "text") -> DataFrame:
    """text and meta (a struct of META) of each row; what a row lacks is null.  Other columns than text and META pass through."""
    t = F.col(text)
    url = paths.sanitize_url(_get(chunks, "url"))
    repo = _get(chunks, "repo")
    n = F.coalesce(_get(chunks, "tokens", "long"), tx.count_tokens(t)) if "tokens" in chunks.columns else tx.count_tokens(t)
    derived = {
        "path": paths.slashes(_get(chunks, "path")),
        "url": url,
        "source": F.coalesce(_get(chunks, "source"), _get(chunks, "repo_url"), F.when(repo.isNotNull(), F.concat(F.lit("https://github.com/"), repo))),
        "source_domain": F.coalesce(_get(chunks, "source_domain"), paths.url_domain(url)),
        "lang": F.coalesce(_get(chunks, "lang"), F.lit("Text")),
        "lang_score": _get(chunks, "lang_score", "double"),
        "chunk_id": F.coalesce(_get(chunks, "chunk_id", "int"), F.lit(1)),
        "n_chunks": F.coalesce(_get(chunks, "n_chunks", "int"), F.lit(1)),
        "encoding": F.coalesce(_get(chunks, "encoding"), F.lit("utf-8")),
        "had_replacement": F.coalesce(_get(chunks, "had_replacement", "boolean"), F.lit(False)),
        "decoding_fallback_used": F.when(_get(chunks, "encoding").isin(*_FALLBACK), True),
        "sha256": tx.content_hash(t),
        "approx_tokens": n,
        "tokens": n,
        "bytes": F.octet_length(t).cast("long"),
        "nlines": tx.n_lines(t),
        "schema_version": F.lit(SCHEMA_VERSION),
        **{c: _get(chunks, c, "long") for c in ("file_bytes", "truncated_bytes", "file_nlines")},
    }
    meta = F.struct(*[derived.get(c, _get(chunks, c)).alias(c) for c in META])
    rest = [c for c in chunks.columns if c not in {text, "start", "end", "mode", "fmt", "repo_url", *META}]
    return chunks.select(t.alias("text"), meta.alias("meta"), *rest)


def from_files(files: DataFrame, policy: ck.Policy = ck.Policy()) -> DataFrame:
    """Records of decoded files (path, text, ...): classified, chunked, built.  Empty texts give none."""
    marked = classify(files).withColumn("file_nlines", tx.n_lines(F.col("text")))
    return build(ck.chunk(marked, mode="mode", fmt="fmt", policy=policy))


def identity(text: Column, doc_id: Column | None = None) -> Column:
    own = F.sha1(F.encode(text, "UTF-8"))
    return own if doc_id is None else F.coalesce(F.nullif(doc_id.cast("string"), F.lit("")), own)


def label(meta: Column) -> Column:
    """How messages name a record: its path, else its chunk, else '<unknown>'."""
    return F.coalesce(meta["path"], meta["sha256"], F.lit("<unknown>"))


def without_summaries(records: DataFrame) -> DataFrame:
    """Drops header and summary rows (meta.kind)."""
    return records.where(F.coalesce(~F.col("meta.kind").isin(*SUMMARY_KINDS), F.lit(True)))


def tag_languages(records: DataFrame) -> DataFrame:
    """Fills meta.language by the human-language baseline and meta.lang by the code baseline where it says nothing."""
    t, m = F.col("text"), F.col("meta")
    code = paths.code_lang(t, m["path"])
    dull = F.lower(F.coalesce(m["lang"], F.lit(""))).isin("", "text", "unknown")
    lang = F.when(dull & code.isNotNull(), paths.display_lang(code)).otherwise(m["lang"])
    human = F.coalesce(m["language"], tx.human_language(t))
    return records.withColumn("meta", m.withField("lang", lang).withField("language", human).withField("lang_score", F.coalesce(m["lang_score"], F.when(human.isNotNull() | (dull & code.isNotNull()), 0.6))))


def schema_versions(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("meta.schema_version", F.lit("missing")).alias("schema_version")).agg(F.count("*").alias("records"))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One record text for each conversation: 'role: text' lines in order of turn."""
    part = F.struct(F.col(turn).alias("t"), F.concat_ws(": ", "role", "text").alias("x"))
    rows = turns.groupBy(conv).agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select(conv, F.size("p").cast("long").alias("n_turns"), F.array_join(F.transform("p", lambda x: x["x"]), "\n").alias("text"))
