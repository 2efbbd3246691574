"""Main content of web pages: a conditional random field over the leaf blocks of the DOM.

A page is parsed into leaf blocks: the text between block-level tags, each with
its open tags.  Features are the ancestor tags (and class or id words of
theirs), text shape, link share and position; the field, trained on pages whose
content is known, labels the blocks by Viterbi, and the content blocks are
joined by line feeds.

Training pages are those whose URL names a document (its number), a bounded
sample of ``TRAIN_PAGES`` in order of a hash of the id; a block is content if
its text is a line of that document.

Defined cases: a null page gives null text and no blocks; an empty page, or one
without text, gives empty text.  Unclosed and stray tags are handled as in HTML:
p, li, td and the like close by themselves, stray end tags are ignored, and an
unterminated comment, script or tag runs to the end.  Without training pages
every block is content.  Repeated rows are extracted each on its own; other columns aren't read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import crf

#: Bound of the sample of labelled pages that the field is fitted on; pages.
TRAIN_PAGES = 500
FEATURES = 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "iframe", "svg")}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_P_ENDERS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_TAGS = {n: i for i, n in enumerate(("article", "main", "nav", "header", "footer", "aside", "ul", "li", "table", "form", "p", "div", "title", "head"))}
_NAMED = re.compile(r"(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)
_BOILER = re.compile(r"\b(?:ad|ads|advert\w*|banner|nav\w*|menu|foot\w*|side\w*|promo|related|share|social|cookie\w*|comment\w*|breadcrumb\w*)\b", re.I)
_SPACES = re.compile(r"\s+")


def blocks(page: str) -> list[tuple[str, frozenset, bool, int]]:
    """Leaf blocks in order: text, open tags, whether a class or id of theirs sounds like boilerplate, characters in links."""
    out: list = []
    stack: list[tuple[str, bool]] = []
    pieces: list[str] = []
    links, at, n = 0, 0, len(page)

    def flush():
        nonlocal links
        if pieces:
            text = _SPACES.sub(" ", "".join(pieces)).strip()
            if text:
                out.append((text, frozenset(t for t, _ in stack), any(b for _, b in stack), links))
            pieces.clear()
        links = 0

    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = page[at:stop]
            if "&" in text:
                text = entities.unescape(text)
            pieces.append(text)
            if any(t == "a" for t, _ in stack):
                links += len(text)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        if name not in _INLINE:
            flush()
            closes = _SELF_CLOSING.get(name, set()) | ({"p"} if name in _P_ENDERS else set())
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "select"):
                        break
        if name in _VOID or m.group(3).endswith("/"):
            continue
        named = _NAMED.search(m.group(3)) if m.group(3) else None
        stack.append((name, bool(named and _BOILER.search(named.group(1)))))
    flush()
    return out


def features(found: list) -> np.ndarray:
    x = np.zeros((len(found), FEATURES), np.float32)
    n = max(1, len(found) - 1)
    for i, (text, tags, boiler, links) in enumerate(found):
        r = x[i]
        r[0] = 1
        for t in tags:
            k = _TAGS.get(t)
            if k is not None:
                r[1 + k] = 1
        r[15] = any(t in tags for t in ("h1", "h2", "h3", "h4", "h5", "h6"))
        r[16] = boiler
        size, words = len(text), text.count(" ") + 1
        r[17] = min(1.0, links / size)
        r[18], r[19], r[20], r[21] = words < 3, words < 10, words >= 25, min(1.0, size / words / 20)
        r[22] = text[-1] in ".!?:;\"'"
        r[23] = text[:1].isupper()
        r[24] = "©" in text or "copyright" in text.lower()
        r[25] = sum(map(text.count, ".,;")) > 0.05 * words
        r[26] = any(c.isdigit() for c in text)
        r[27] = " | " in text or "·" in text
        r[28] = i / n
        r[29], r[30] = i < 2, i > len(found) - 3
        r[31] = text.isupper()
    return x


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def fit(pages: DataFrame, docs: DataFrame, train_pages: int = TRAIN_PAGES) -> crf.Model:
    """Fits the field on at most train_pages pages (the documented bound) whose URL names a document."""
    rows = _page_rows(pages).where("page_id is not null and html is not null")
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})(?:[.?#/]|$)', 1), '') as bigint)")
    chosen = rows.select("page_id", number.alias("doc_id")).dropna().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    sample = rows.join(F.broadcast(chosen), "page_id").select("page_id", "doc_id", "html")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    lines = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    lines = lines.groupBy("doc_id").agg(F.max("text").alias("text"))

    def run(batches):
        for b in batches:
            out = []
            for page, text in zip(b.column("html").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = blocks(page)
                known = {_SPACES.sub(" ", line).strip() for line in text.split("\n")} - {""}
                y = np.array([t in known and "title" not in tags for t, tags, _, _ in found], np.float32)
                out.append(np.concatenate([y[:, None], features(found)], 1).tobytes() if found and y.any() else b"")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.binary())], ["page_id", "x"])

    got = sample.join(lines, "doc_id").select("page_id", "html", "text").mapInArrow(run, "page_id long, x binary").collect()
    sequences = []
    for r in sorted(got, key=lambda r: (r.page_id, bytes(r.x))):
        a = np.frombuffer(r.x, np.float32).reshape(-1, FEATURES + 1).astype(np.float64)
        for k in range(0, len(a), 128):
            sequences.append((a[k : k + 128, 1:], a[k : k + 128, 0].astype(int)))
    return crf.train(sequences, FEATURES)


def extract(page: str | None, model: crf.Model) -> tuple[str | None, int, int]:
    """Content, number of blocks, number of content blocks."""
    if page is None:
        return None, 0, 0
    found = blocks(page)
    y = crf.viterbi((features(found).astype(np.float64) @ np.array(model.w)).tolist(), model) if found else []
    return "\n".join(b[0] for b, k in zip(found, y, strict=True) if k), len(found), sum(y)


def extract_pages(pages: DataFrame, model: crf.Model) -> DataFrame:
    """page_id, url, text, n_blocks, n_content for every page, in one pass."""

    def run(batches):
        for b in batches:
            rows = [extract(h, model) for h in b.column("html").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["page_id", "url", "text", "n_blocks", "n_content"])

    return _page_rows(pages).mapInArrow(run, "page_id long, url string, text string, n_blocks int, n_content int")
