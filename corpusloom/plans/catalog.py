"""The registered queries of the library's own operators, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import chunk as ck
from corpusloom.functions import kql, licence, paths, safety, score, signals
from corpusloom.functions import text as tx
from corpusloom.operators import dedup, records, screen, stats
from corpusloom.session import ensure_importable
from corpusloom.sinks import card
from corpusloom.sources import web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t():
    return F.col("text")


def query(sql: str | None = None):
    """Registers a function (spark, table) -> DataFrame under its name; ``table`` reads a table of the folder."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _re2(pattern: str) -> str:
    """A pattern of functions.text in RE2's spelling, quoted for SQL."""
    import re

    out = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)
    out = out.replace(r"\x85", r"\x{85}").replace(r"\xA0", r"\x{A0}")
    return "'" + out.replace("'", "''") + "'"


_SP = tx.SPACES
_BREAK = tx.LINE_BREAK
_LINES = f"(CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, {_re2(f'(?:{_BREAK})$')}, ''), {_re2(_BREAK)}) END)"
_FILLED = f"list_filter({_LINES}, lambda x: regexp_matches(x, {_re2(f'[^{_SP}]')}))"
_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
_N_WORDS, _N_STOP = f"len({_WORDS})", f"len(list_filter({_WORDS}, lambda x: x IN {_STOP}))"
_N_LETTERS = "length(regexp_replace(lower(text), '[^a-z]', '', 'g'))"
_N_SYMBOLS = f"length(regexp_replace(text, {_re2(rf'[\p{{L}}\p{{N}}{_SP}]')}, '', 'g'))"
_N_ASCII = r"length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))"


def _n_of(chars: str) -> str:
    return f"(length(text) - length(translate(text, '{chars}', '')))"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)"


_BULLETS = _div(f"len(list_filter({_FILLED}, lambda x: regexp_matches(x, {_re2(tx.BULLET)})))", f"len({_FILLED})")
_DOTS = _re2(r"(?:\.\.\.|…)[" + _SP + "]*$")
_ELLIPSES = _div(f"len(list_filter({_FILLED}, lambda x: regexp_matches(x, {_DOTS})))", f"len({_FILLED})")
_FLAGS = {
    "min_words": f"{_N_WORDS} >= 50",
    "mean_word_len": f"{_div(_N_LETTERS, _N_WORDS)} BETWEEN 3 AND 8",
    "symbol_ratio": f"{_div(_N_SYMBOLS, 'length(text)')} <= 0.15",
    "stopword_ratio": f"{_div(_N_STOP, _N_WORDS)} >= 0.20",
    "bullet_ratio": f"{_BULLETS} <= 0.50",
    "ellipsis_ratio": f"{_ELLIPSES} <= 0.30",
}
_GOPHER = "((" + " + ".join(f"({v})::INT" for v in _FLAGS.values()) + ")::DOUBLE / 6)"
_BARE = _re2(f"^[{_SP}]+|[{_SP}]+$")
_SHORT = f"len(list_filter({_LINES}, lambda x: length(regexp_replace(x, {_BARE}, '', 'g')) <= 60))"
_COMPLEX = f"(CASE WHEN text = '' THEN 0 ELSE least(1.0::DOUBLE, 0.5::DOUBLE * {_n_of(tx.CODE_MARKS)} / length(text) + 0.5::DOUBLE * ({_SHORT}::DOUBLE / greatest(len({_LINES}), 1))) END)"
_TOKENS = "greatest(1, (length(text) + 3) // 4)"
_LENGTH_OK = f"(CASE WHEN {_TOKENS} BETWEEN 1500 AND 2000 THEN 1 ELSE greatest(0::DOUBLE, 1 - abs({_TOKENS} - 1750)::DOUBLE / 2000) END)"
_ASCII = f"(CASE WHEN text = '' THEN 1 ELSE {_N_ASCII}::DOUBLE / length(text) END)"
_PROSE = rf"(CASE WHEN regexp_matches(text, {_re2(score.MD_HEADING)}) OR regexp_matches(text, {_re2(score.RST_HEADING)}) OR length(text) > 400 THEN 1 ELSE 0.7::DOUBLE END)"
_REPEATS = """rep AS (SELECT doc_id, count(*) - count(DISTINCT substr(text, i, 16)) AS repeats, count(*) AS grams
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 14)) AS i FROM documents WHERE length(text) >= 32) GROUP BY doc_id)"""
_SCORED = f"""{_REPEATS}, scored AS (SELECT documents.doc_id, documents.lang, documents.source, text,
  100 * (0.25::DOUBLE * {_LENGTH_OK} + 0.20::DOUBLE * (1 - least(coalesce(repeats::DOUBLE / grams, 0), 1)) + 0.05::DOUBLE * least({_COMPLEX} / 1.5::DOUBLE, 1)
  + 0.05::DOUBLE * {_ASCII} + 0.20::DOUBLE * {_PROSE} + 0.15::DOUBLE * 0.5::DOUBLE + 0.10::DOUBLE * {_GOPHER}) AS score FROM documents LEFT JOIN rep USING (doc_id))"""


# text signals


@query(f"SELECT doc_id, {_N_ASCII} AS n_ascii, {_ASCII} AS ascii_ratio FROM documents")
def ascii_ratio(spark, table):
    return table("documents").select("doc_id", tx.ascii_count(_t()).alias("n_ascii"), tx.ascii_ratio(_t()).alias("ascii_ratio"))


@query(f"SELECT doc_id, {_TOKENS} AS n_tokens, 1500 AS lo, 2000 AS hi, {_LENGTH_OK} AS length_ok FROM documents")
def length_ok(spark, table):
    band, n = score.target_band(F.lit("Text")), tx.qc_tokens(_t())
    return table("documents").select("doc_id", n.alias("n_tokens"), band["lo"].alias("lo"), band["hi"].alias("hi"), score.length_ok(n, F.lit("Text")).alias("length_ok"))


_DIGITS = r"length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))"
_MARKS_SQL = tx.TOKEN_MARKS


@query(rf"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE ceil(length(text) / least(4.6::DOUBLE, greatest(2.8::DOUBLE, 4.0::DOUBLE - 0.8::DOUBLE * (({_n_of(_MARKS_SQL)} + {_DIGITS})::DOUBLE / length(text)) + 0.2::DOUBLE * ((length(text) - length(translate(text, ' ' || chr(10) || chr(9), '')))::DOUBLE / length(text))))) END::BIGINT AS tokens FROM documents""")
def count_tokens(spark, table):
    return table("documents").select("doc_id", tx.count_tokens(_t()).alias("tokens"))


@query(f"WITH {_REPEATS} SELECT doc_id, coalesce(repeats, 0) AS repeats, coalesce(repeats::DOUBLE / grams, 0) AS repetition FROM documents LEFT JOIN rep USING (doc_id)")
def repetition_rate(spark, table):
    s = signals.text_signals(sim=False, min_hash=False)
    return table("documents").select("doc_id", s(_t()).alias("s")).select("doc_id", "s.repeats", "s.repetition")


@query(f"SELECT doc_id, {_n_of(tx.CODE_MARKS)} AS n_marks, {_SHORT} AS n_short_lines, {_COMPLEX} AS complexity FROM documents")
def code_complexity(spark, table):
    ls = F.col("__lines")
    rows = tx.bound(table("documents").select("doc_id", "text")).withColumns({"n_marks": tx.code_mark_count(_t()), "n_short_lines": tx.short_line_count(_t(), ls=ls)})
    return rows.select("doc_id", "n_marks", "n_short_lines", tx.code_complexity(_t(), ls=ls, n_short=F.col("n_short_lines"), n_marks=F.col("n_marks")).alias("complexity"))


@query(f"SELECT doc_id, {_N_WORDS} AS n_words, {_N_STOP} AS n_stop, {_N_LETTERS} AS n_letters FROM documents")
def word_stats(spark, table):
    return table("documents").select("doc_id", tx.word_count(_t()).alias("n_words"), tx.stop_word_count(_t()).alias("n_stop"), tx.letter_count(_t()).alias("n_letters"))


@query(f"SELECT doc_id, {_N_SYMBOLS} AS n_symbols, {_BULLETS} AS bullet_ratio, {_ELLIPSES} AS ellipsis_ratio FROM documents")
def line_shape(spark, table):
    full = F.col("__filled")
    return tx.bound(table("documents").select("doc_id", "text")).select("doc_id", tx.symbol_count(_t()).alias("n_symbols"), tx.bullet_ratio(_t(), full).alias("bullet_ratio"), tx.ellipsis_ratio(_t(), full).alias("ellipsis_ratio"))


@query("SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _FLAGS.items()) + f", {_GOPHER} AS gopher_score FROM documents")
def gopher(spark, table):
    flags = tx.gopher_flags(_t(), True)
    rows = tx.bound(table("documents").select("doc_id", "text")).select("doc_id", *[c.alias(k) for k, c in flags.items()])
    return rows.select("*", tx.mean_of_flags([F.col(k) for k in flags]).alias("gopher_score"))


@query(f"SELECT doc_id, {_PROSE} AS parse_ok FROM documents")
def parse_ok_text(spark, table):
    return table("documents").select("doc_id", score.parse_ok(_t(), F.lit("Text")).alias("parse_ok"))


@query("SELECT event_id, CASE WHEN json_valid(props) THEN 1.0 ELSE 0.0 END::DOUBLE AS parse_ok FROM events")
def parse_ok_json(spark, table):
    return table("events").select("event_id", score.parse_ok(F.col("props"), F.lit("JSON")).alias("parse_ok"))


_N_LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END"


@query(f"SELECT doc_id, sha256(text) AS content_hash, {_N_LINES} AS n_lines, octet_length(encode(text)) AS n_bytes FROM documents")
def content_hash(spark, table):
    return table("documents").select("doc_id", tx.content_hash(_t()).alias("content_hash"), tx.n_lines(_t()).alias("n_lines"), F.octet_length(_t()).alias("n_bytes"))


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 2048), '[A-Za-z]') AND NOT regexp_matches(regexp_replace(substr(text, 1, 2048), '[A-Za-z]', '', 'g'), '\p{{L}}') THEN 'en' END AS language FROM documents")
def human_language(spark, table):
    return table("documents").select("doc_id", tx.human_language(_t()).alias("language"))


@query(r"SELECT page_id, md5(regexp_replace(html, '\r\n?', chr(10), 'g')) AS html FROM pages")
def newline_norm(spark, table):
    return table("pages").select("page_id", F.md5(F.encode(tx.newline_norm(F.col("html")), "UTF-8")).alias("html"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{E000}-\x{F8FF}]', '', 'g')) AS text FROM documents")
def control_strip(spark, table):
    return table("documents").select("doc_id", F.md5(F.encode(tx.strip_controls(_t()), "UTF-8")).alias("text"))


# score and screens


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def base_score(spark, table):
    return screen.quality(table("documents").select("doc_id", "text")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT doc_id, CASE WHEN score < 60 THEN 'low_score' END AS qc_reason, score < 60 AS qc_would_drop FROM scored")
def score_decision(spark, table):
    return screen.quality_decision(screen.quality(table("documents").select("doc_id", "text"))).select("doc_id", "qc_reason", "qc_would_drop")


@query(f"WITH {_SCORED} SELECT lang, count(*) AS scored, count(*) FILTER (score >= 60) AS kept, count(*) FILTER (score < 60) AS dropped, count(*) FILTER (score < 60) AS would_drop, round(avg(score), 6) AS avg_score FROM scored GROUP BY lang")
def screen_summary(spark, table):
    rows = screen.quality_decision(screen.quality(table("documents").select("doc_id", "text", "lang")))
    return screen.screener_counts(rows, "qc_would_drop", ["lang"], value="score").withColumn("avg_score", F.round("avg_score", 6))


@query(f"""WITH {_SCORED}, long AS (SELECT 'score' AS signal, score AS v FROM scored UNION ALL SELECT 'ascii_ratio', {_ASCII} FROM documents UNION ALL SELECT 'n_tokens', {_TOKENS} FROM documents UNION ALL SELECT 'parse_ok', {_PROSE} FROM documents)
  SELECT signal, count(v) AS count, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v), 6) AS stdev FROM long GROUP BY signal""")
def signal_stats(spark, table):
    rows = stats.signal_stats(screen.quality(table("documents").select("doc_id", "text")), ["score", "ascii_ratio", "n_tokens", "parse_ok"])
    return rows.select("signal", "count", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "stdev")])


_PII = f"len(regexp_extract_all(text, {_re2(safety.EMAIL)})) AS num_emails, len(regexp_extract_all(text, {_re2(safety.PHONE)})) AS num_phones"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = f"len(list_filter(regexp_extract_all(text, {_re2(safety.IPV4)}), lambda x: regexp_full_match(x, '{_OCTET}(?:\\.{_OCTET}){{3}}')))"
_IPV6 = rf"len(list_filter(regexp_extract_all(text, {_re2(safety.IPV6)}), lambda x: regexp_full_match(x, '(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}')))"
_HITS = rf"len(regexp_extract_all(lower(text), '\b(?:{'|'.join(safety.TOXIC_TERMS)})\b'))"
_SAFE = f"safe AS (SELECT doc_id, lang, source, {_PII}, {_IPV4} + {_IPV6} AS num_ips, {_HITS} AS hits FROM documents)"
_DECISION = "CASE WHEN num_emails + num_phones + num_ips > 0 THEN 'drop' WHEN hits > 0 THEN 'review' ELSE 'keep' END"


@query(f"SELECT doc_id, {_PII}, {_IPV4} AS num_ipv4, {_IPV6} AS num_ipv6 FROM documents")
def pii_counts(spark, table):
    return table("documents").select("doc_id", safety.email_count(_t()).alias("num_emails"), safety.phone_count(_t()).alias("num_phones"), safety.ipv4_count(_t()).alias("num_ipv4"), safety.ipv6_count(_t()).alias("num_ipv6"))


@query(f"SELECT doc_id, {_HITS} AS hits, least(1.0::DOUBLE, {_HITS} / 8.0::DOUBLE) AS toxicity FROM documents")
def toxicity(spark, table):
    return table("documents").select("doc_id", safety.toxic_hits(_t()).alias("hits"), safety.toxicity(_t()).alias("toxicity"))


@query(f"WITH {_SAFE} SELECT doc_id, num_emails, num_phones, num_ips, {_DECISION} AS safety_decision, CASE WHEN num_emails + num_phones + num_ips > 0 THEN 'pii' END AS safety_reason FROM safe")
def safety_decision(spark, table):
    return screen.safety_rows(table("documents")).select("doc_id", "num_emails", "num_phones", "num_ips", "safety_decision", "safety_reason")


@query(f"SELECT doc_id, md5(regexp_replace(text, {_re2(safety.EMAIL)}, '[EMAIL]', 'g')) AS scrubbed FROM documents")
def pii_scrub(spark, table):
    return table("documents").select("doc_id", F.md5(F.encode(safety.scrub_emails(_t()), "UTF-8")).alias("scrubbed"))


@query(f"WITH {_SAFE} SELECT toxic, {_DECISION} AS safety_decision, count(*) AS n FROM safe JOIN labels USING (doc_id) GROUP BY ALL")
def safety_vs_labels(spark, table):
    rows = screen.safety_rows(table("documents")).select("doc_id", "safety_decision")
    return rows.join(table("labels"), "doc_id").groupBy("toxic", "safety_decision").agg(F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT quality, score < 60 AS low, count(*) AS n FROM scored JOIN labels USING (doc_id) GROUP BY ALL")
def quality_vs_labels(spark, table):
    docs = table("documents").select("doc_id", "text").join(table("labels"), "doc_id")
    return screen.quality(docs).groupBy("quality", (F.col("score") < 60).alias("low")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORED}, {_SAFE}, b AS (SELECT score < 60 AS q, num_emails + num_phones + num_ips > 0 AS s FROM scored JOIN safe USING (doc_id))
  SELECT 'quality' AS screener, count(*) AS scored, count(*) FILTER (NOT q) AS kept, count(*) FILTER (q) AS dropped FROM b
  UNION ALL SELECT 'safety', count(*) FILTER (NOT q), count(*) FILTER (NOT q AND NOT s), count(*) FILTER (NOT q AND s) FROM b""")
def screen_chain(spark, table):
    rows = screen.safety_rows(screen.quality_decision(screen.quality(table("documents").select("doc_id", "text"))))
    return screen.chain_counts(rows, [("quality", "qc_would_drop"), ("safety", "safety_would_drop")])


# duplicates


@query("SELECT doc_id, sha256(text) AS content_hash, nullif(min(doc_id) OVER w, doc_id) AS dup_of, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)")
def exact_dups(spark, table):
    return dedup.exact_duplicates(table("documents"))


@query("""WITH f AS (SELECT min(doc_id) AS dup_family_id, count(*) AS count, list_slice(list(doc_id ORDER BY doc_id), 1, 3) AS examples FROM documents GROUP BY text HAVING count(*) >= 2)
  SELECT dup_family_id, count, array_to_string(examples, ',') AS examples FROM f ORDER BY count DESC, dup_family_id LIMIT 5""")
def dup_families_topk(spark, table):
    rows = dedup.exact_duplicates(table("documents")).select("doc_id", F.coalesce("dup_of", "doc_id").alias("dup_family_id"))
    return dedup.top_families(rows).select("dup_family_id", "count", F.array_join("examples", ",").alias("examples"))


_BYTES = "b AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i - 1, 2))::INT AS v FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, octet_length(encode(text)) + 1)) AS i FROM documents))"
_GRAMS = f"""{_BYTES}, g AS (SELECT doc_id, i, v AS a, lead(v, 1) OVER w AS c, lead(v, 2) OVER w AS d, lead(v, 3) OVER w AS e, lead(v, 4) OVER w AS f FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  x AS (SELECT DISTINCT doc_id, ((5 + 5 * a + 4 * c + 3 * d + 2 * e + f)::BIGINT << 16) | (1 + a + c + d + e + f) AS h FROM g WHERE f IS NOT NULL AND greatest(a, c, d, e, f) > 32)"""


@query(f"WITH {_GRAMS} SELECT doc_id, count(h) AS n_shingles, coalesce(sum(h), 0)::BIGINT AS total FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id")
def adler_shingles(spark, table):
    def run(batches):
        import pandas as pd

        for b in batches:
            found = [signals.shingle_hashes(t or "") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [len(h) for h in found], "total": [int(h.sum()) for h in found]})

    return table("documents").select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, total long")


_MINS = ", ".join(f"coalesce(min(({a}::UBIGINT * h + {b}::UBIGINT) % {signals.PRIME}::UBIGINT), {signals.PRIME})::BIGINT AS m{i}" for i, (a, b) in enumerate(signals.coefficients()))


@query(f"WITH {_GRAMS}, u AS (SELECT doc_id, h::UBIGINT AS h FROM x) SELECT doc_id, {_MINS} FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id")
def minhash_signature(spark, table):
    """All 128 values."""
    s = signals.text_signals(repetition=False, sim=False)
    rows = table("documents").select("doc_id", s(_t()).alias("s")).select("doc_id", F.col("s.minhash").alias("s"))
    return rows.select("doc_id", *[F.col("s")[i].alias(f"m{i}") for i in range(128)])


@query()
def simhash_window_dups(spark, table):
    return dedup.simhash_window(spark, dedup.sketches(table("documents"), min_hash=False))


@query()
def lsh_dups(spark, table):
    return dedup.lsh_duplicates(spark, dedup.sketches(table("documents"), sim=False))


@query()
def near_dup_score(spark, table):
    rows = screen.with_duplicates(spark, screen.quality(table("documents").select("doc_id", "text")))
    return rows.select("doc_id", "near_dup", "dup_family_id", F.round("score", 6).alias("score"))


# paths, URLs, links


_URL_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract({_URL_PATH}, '([^/]*)/*$', 1)) AS name FROM pages), e AS (SELECT page_id, name, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS ext FROM p)
  SELECT page_id, CASE WHEN name IN ({", ".join(f"'{n}'" for n in paths.SPECIAL)}) OR ext IN ({", ".join(f"'{x}'" for x in sorted(paths.CODE_EXTS))}) THEN 'code' ELSE 'doc' END AS kind,
  coalesce(CASE name {" ".join(f"WHEN '{n}' THEN '{v}'" for n, v in paths.SPECIAL.items())} END, CASE ext {" ".join(f"WHEN '{n}' THEN '{v}'" for n, v in paths.LANG_OF.items())} END, CASE WHEN ext <> '' THEN substr(ext, 2) ELSE 'text' END) AS lang FROM e""")
def path_lang(spark, table):
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    guess = paths.lang_hint(path)
    return table("pages").select("page_id", guess["kind"].alias("kind"), guess["lang"].alias("lang"))


@query(rf"SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https') THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#@]+)', 1)) || {_URL_PATH} END AS clean_url, lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#@:]+)', 1)) AS domain FROM pages")
def url_sanitize(spark, table):
    return table("pages").select("page_id", paths.sanitize_url(F.col("url")).alias("clean_url"), paths.url_domain(F.col("url")).alias("domain"))


@query()
def page_links(spark, table):
    return web.links(table("pages"), suffix=None)


@query("SELECT page_id, CASE WHEN list_has_any(string_split_regex(lower(url), '[/_.-]+'), ['defender', 'defenderforendpoint', 'm365d', 'mde']) THEN 'mde' WHEN list_contains(string_split_regex(lower(url), '[/_.-]+'), 'sentinel') THEN 'sentinel' WHEN list_contains(string_split_regex(lower(url), '[/_.-]+'), 'mdi') THEN 'mdi' ELSE 'generic' END AS category FROM pages")
def path_category(spark, table):
    return table("pages").select("page_id", kql.category(F.col("url")).alias("category"))


_KQL_WORDS = " + ".join("contains(lower(text), '" + w + "')::INT" for w in kql._WORDS)


@query(rf"SELECT doc_id, (contains(text, '|') AND regexp_matches(lower(trim(text)), ' (?:extend|join|mv-expand|summarize|union|where) | project')) OR regexp_matches(lower(trim(text)), '(?m)^[ \t]*(?:datatable|let|print|range) ') OR ({_KQL_WORDS}) >= 2 AS kql FROM documents")
def probable_kql(spark, table):
    return table("documents").select("doc_id", kql.probable_column(_t()).alias("kql"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " AND ".join(f"contains(replace(replace(lower(text), '\"', ''), '''', ''), '{p}')" for p in ph) + f" THEN '{n}'" for n, ph in licence.PHRASES) + " END AS spdx FROM documents")
def licence_phrases(spark, table):
    plain = F.translate(F.lower(_t()), "\"'", "")
    out = None
    for name, phrases in licence.PHRASES:
        hit = plain.contains(phrases[0])
        for p in phrases[1:]:
            hit = hit & plain.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return table("documents").select("doc_id", out.alias("spdx"))


@query("SELECT source, count(*) AS docs FROM documents WHERE source NOT IN ('src1', 'src3', 'src5') OR source IS NULL GROUP BY source")
def allowlist_anti(spark, table):
    blocked = spark.createDataFrame([("src1",), ("src3",), ("src5",)], "source string")
    return table("documents").join(F.broadcast(blocked), "source", "left_anti").groupBy("source").agg(F.count("*").alias("docs"))  # three rows


# chunks and records


@query("SELECT doc_id, length(text) AS n_chars, sha256(text) AS joined FROM documents")
def chunk_tiling(spark, table):
    """Chunks without overlap, joined up again; the empty text has none."""
    rows = ck.chunk(table("documents").select("doc_id", "text"), policy=ck.Policy(target=200, overlap=0, minimum=50, semantic=True))
    part = F.sort_array(F.collect_list(F.struct("chunk_id", "text")))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(part, lambda x: x["text"]), "").alias("t"), F.max("end").cast("long").alias("n_chars"))
    every = table("documents").select("doc_id").join(joined, "doc_id", "left")
    return every.select("doc_id", F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"), tx.content_hash(F.coalesce("t", F.lit(""))).alias("joined"))


@query()
def chunk_docs(spark, table):
    return ck.chunk(table("documents").select("doc_id", "text", "lang"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, length(text) - length(replace(text, chr(10), '')) + (text <> '')::INT AS nlines, source, 'Text' AS lang, '2' AS schema_version FROM documents")
def record_meta(spark, table):
    docs = table("documents").select("doc_id", "text", "source", F.col("lang").alias("language"))
    rows = records.build(docs)
    return rows.select("doc_id", *[F.col(f"meta.{c}").alias(c) for c in ("sha256", "bytes", "nlines", "source", "lang", "schema_version")])


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def conversation_records(spark, table):
    return records.conversations(table("conversations")).select("conv_id", "n_turns", F.md5(F.encode("text", "UTF-8")).alias("text"))


# statistics and cards


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) AS shard FROM documents")
def shard_assign(spark, table):
    tables = dedup.Tables(spark, "shards")
    rows = dedup.numbered(tables, table("documents").select("doc_id"), ["doc_id"], "ordered")
    total = tables.spark.read.parquet(f"{tables.root}/ordered").count()
    return rows.select("doc_id", stats.shard_of(F.col("ordinal"), F.lit(total), 7).alias("shard"))


@query("""WITH s AS (SELECT doc_id % 5 AS shard, n_chars::DOUBLE AS v FROM documents)
  SELECT 'n_chars' AS signal, count(v) AS count, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(stddev_pop(v), 4) AS stdev FROM s""")
def merge_stats(spark, table):
    """Statistics of five shards, pooled from what each reports."""
    shards = [table("documents").where(F.col("doc_id") % 5 == k) for k in range(5)]
    reported = [stats.moments(stats.signal_stats(s, ["n_chars"])) for s in shards]
    out = reported[0]
    for r in reported[1:]:
        out = out.unionByName(r)
    return stats.pooled(out).select("signal", "count", F.round("mean", 6).alias("mean"), "min", "max", F.round("stdev", 4).alias("stdev"))


@query("""SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' ELSE '10K<n<100K' END AS size_category,
  CASE WHEN count(DISTINCT lang) = 1 THEN 'monolingual' WHEN count(DISTINCT lang) > 1 THEN 'multilingual' END AS multilinguality FROM documents GROUP BY source""")
def size_buckets(spark, table):
    rows = table("documents").groupBy("source").agg(F.count("*").alias("n"), F.collect_set("lang").alias("langs"))
    return rows.select("source", "n", stats.size_bucket(F.col("n")).alias("size_category"), stats.multilinguality(F.col("langs")).alias("multilinguality"))


@query("SELECT count(*) AS num_examples, sum(octet_length(encode(text))) AS num_bytes, array_to_string(list_sort(list(DISTINCT lang)), ',') AS language FROM documents")
def card_totals(spark, table):
    """Fragments of two splits, merged."""
    docs = records.build(table("documents").select("doc_id", "text", F.col("lang").alias("language")))
    parts = [card.fragment(docs.where(F.col("doc_id") % 2 == k), f"part{k}", s) for k, s in enumerate(("train", "test"))]
    return card.merge(parts[0].unionByName(parts[1])).select("num_examples", "num_bytes", F.array_join("language", ",").alias("language"))


@query("SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_lang_source(spark, table):
    return table("documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS place, 'page' AS kind, length(html) AS size FROM pages UNION ALL SELECT source, 'document', n_chars FROM documents UNION ALL SELECT role, 'turn', length(text) FROM conversations")
def union_sources(spark, table):
    pages = table("pages").select(paths.url_domain(F.col("url")).alias("place"), F.lit("page").alias("kind"), F.length("html").cast("long").alias("size"))
    docs = table("documents").select(F.col("source").alias("place"), F.lit("document").alias("kind"), F.col("n_chars").alias("size"))
    turns = table("conversations").select(F.col("role").alias("place"), F.lit("turn").alias("kind"), F.length("text").cast("long").alias("size"))
    return pages.unionByName(docs).unionByName(turns)


# the relational surface that comes with the engine


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, table):
    rows = table("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_revenue(spark, table):
    rows = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def top_orders(spark, table):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table("orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("place")).where("place <= 3")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def idle_customers(spark, table):
    return table("customer").join(table("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT n_nationkey FROM nation")
def set_operations(spark, table):
    rich = table("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return table("customer").select(F.col("c_nationkey").alias("nation")).subtract(rich.intersect(table("nation").select(F.col("n_nationkey").alias("nation"))))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, table):
    rows = table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
