"""The quality score: bands, syntax checks, weights and penalties, as native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

TEXTY = ("html", "markdown", "restructuredtext", "text")
LOGS = ("csv", "json", "jsonl", "xml", "yaml")
CODE = tuple("bash c c++ go java javascript kql powershell python rust shell sigma spl typescript yara".split())


@dataclass(frozen=True)
class Heuristics:
    """Thresholds of the score.  The four max_ bounds are None for whole texts, or how many grams, tokens, shingles or bytes count."""

    code_band: tuple[int, int] = (2000, 4000)
    log_band: tuple[int, int] = (1000, 2000)
    text_band: tuple[int, int] = (1500, 2000)
    other_band: tuple[int, int] = (1000, 3000)
    repetition_k: int = 16
    repetition_max_grams: int | None = None
    code_short_line: int = 60
    code_punct_weight: float = 0.5
    code_short_weight: float = 0.5
    simhash_max_tokens: int | None = None
    minhash_max_shingles: int | None = None
    parse_max_bytes: int | None = None
    gopher: bool = True
    gopher_weight: float = 0.10

    def __post_init__(self):
        for name in ("code_band", "log_band", "text_band", "other_band"):
            lo, hi = getattr(self, name)
            if not 0 < lo <= hi:
                raise ValueError(f"{name} must be two rising positive numbers")
        if self.repetition_k < 1 or self.code_short_line < 1 or self.gopher_weight < 0:
            raise ValueError("repetition_k and code_short_line must be positive, gopher_weight not negative")


def target_band(lang: Column, h: Heuristics = Heuristics()) -> Column:
    """struct(lo, hi): token counts that suit a language label."""
    low = F.lower(F.coalesce(lang, F.lit("")))

    def pair(b):
        return F.struct(F.lit(b[0]).cast("long").alias("lo"), F.lit(b[1]).cast("long").alias("hi"))

    return F.when(low.isin(*CODE), pair(h.code_band)).when(low.isin(*LOGS), pair(h.log_band)).when(low.isin(*TEXTY), pair(h.text_band)).otherwise(pair(h.other_band))


def length_ok(n: Column, lang: Column, h: Heuristics = Heuristics()) -> Column:
    """1 within the band, else falling with the distance from its middle."""
    b = target_band(lang, h)
    middle = F.floor((b["lo"] + b["hi"]) / 2)
    return F.when(n.between(b["lo"], b["hi"]), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - middle) / b["hi"]))


MD_HEADING = r"(?m)^[\t ]{0,3}(?:#{1,6})[\t ]+[^ \t\n]"
RST_HEADING = r"(?m)^[^\n]{3}[^\n]*\n[\"#'+=^`~-]{3,}[ \t]*$"


def parse_ok(text: Column, lang: Column, parsed: Column | None = None, h: Heuristics = Heuristics()) -> Column:
    """1 if a text reads as its language, 0 if not, 0.7 for short prose without a heading.

    parsed: the result for python, yaml, json and jsonl, from signals.parse_checks; without it these are 0 (json is parsed natively).
    """
    low = F.lower(F.trim(lang))
    prose = F.when((F.length(text) > 400) | text.rlike(MD_HEADING) | text.rlike(RST_HEADING), 1.0).otherwise(0.7)

    def piped(words):
        return F.when(text.contains("|") & text.rlike(rf"(?i)\b(?:{words})\b"), 1.0).otherwise(0.0)

    braces = F.abs(tx.n_of(text, "{") - tx.n_of(text, "}")) <= 3
    rules = F.when(text.rlike(r"(?i)\b(?:rule|detection|condition)\b") & braces, 1.0).otherwise(0.0)
    json_ok = F.when(F.try_parse_json(text).isNotNull(), 1.0).otherwise(0.0)
    checked = parsed if parsed is not None else F.when(low == "json", json_ok).otherwise(0.0)
    return (
        F.when(F.octet_length(text) > h.parse_max_bytes if h.parse_max_bytes is not None else F.lit(False), 0.0)
        .when(low.isin(*TEXTY), prose)
        .when(low == "kql", piped("extend|join|parse|project|summarize|where"))
        .when(low == "spl", piped("eval|join|lookup|rename|rex|stats|table|where"))
        .when(low.isin("sigma", "yara"), rules)
        .when(low.isin("python", "yaml", "json", "jsonl"), checked)
        .otherwise(0.0)
    )


def lm_score(perplexity: Column | None) -> Column:
    """Of a language model's perplexity; 0.5 where there is none."""
    if perplexity is None:
        return F.lit(0.5)
    return F.coalesce(1 / (1 + perplexity / 20.0), F.lit(0.5))


def base_score(length: Column, repetition: Column, complexity: Column, ascii_ratio: Column, parse: Column, lm: Column, gopher: Column, h: Heuristics = Heuristics()) -> Column:
    """Weighted sum, 0 to 1, before penalties."""
    score = 0.25 * length + 0.20 * (1 - F.least(repetition, F.lit(1.0))) + 0.05 * F.least(complexity / 1.5, F.lit(1.0)) + 0.05 * ascii_ratio + 0.20 * parse + 0.15 * lm
    return score + h.gopher_weight * gopher if h.gopher and h.gopher_weight > 0 else score


def dup_penalty(lang: Column, near: Column, hamming: Column | None = None, globally: Column | None = None, sim_threshold: int = 4) -> Column:
    """Factor for near duplicates."""
    factor = F.when(F.lower(lang).isin(*TEXTY), 0.8).otherwise(0.5)
    if hamming is not None:
        factor = factor * F.when(hamming <= max(1, sim_threshold // 2), 0.6).otherwise(1.0)
    if globally is not None:
        factor = factor * F.when(globally, 0.5).otherwise(1.0)
    return F.when(near, factor).otherwise(1.0)
