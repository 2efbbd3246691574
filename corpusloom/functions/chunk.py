"""Structure-aware chunking: blocks of Markdown, reStructuredText or code, packed to a token target.

Blocks tile the text.  Chunks are runs of blocks near the target; a heading
opens a new chunk once half the minimum is reached, and a tail of the chunk
before may overlap into the next.  Token counts are sums over blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.functions.text import TOKEN_MARKS

_MARKS = str.maketrans("", "", TOKEN_MARKS + "".join(chr(c) for c in range(0x110000) if chr(c).isdigit()))
_ATX = re.compile(r"[\t ]{,3}(?:#{1,6})[\t ]+\S")
_SETEXT = re.compile(r"[ \t]{0,3}(?:=+|-+)[ \t]*$")
_OPEN = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_SHUT = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})[ \t]*$")
_RULE = re.compile(r"\s*([-=`:'\"~^_*+#<>|\\])\1{2,}\s*$")
_DIRECTIVE = re.compile(r"[ \t]*\.{2}[ \t]+([a-zA-Z][-\w]*)::.*$", re.A)
_CODE_DIRECTIVES = set("code code-block codeblock highlight literal literalinclude sourcecode".split())
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[0-9A-Z])")
MAX_CODE_LINES = 4000
#: Chunks go back to Spark after texts of so many characters, so that Python never holds those of a whole batch.
RUN = 1 << 20
KINDS = (pa.string(), *[pa.int32()] * 5)


@dataclass(frozen=True)
class Policy:
    target: int = 1700
    overlap: int = 40
    minimum: int = 400
    semantic: bool = False
    semantic_tokens: int | None = None

    def __post_init__(self):
        if self.target < 1 or self.overlap < 0 or self.minimum < 0:
            raise ValueError("target must be positive, overlap and minimum not negative")

    @property
    def block_limit(self) -> int:
        base = self.semantic_tokens if self.semantic_tokens and self.semantic_tokens > 0 else min(self.target, 600)
        return max(80, self.minimum, base)


@dataclass(frozen=True)
class Block:
    text: str
    start: int
    tokens: int
    kind: str


def ratio(text: str, kind: str) -> float:
    if not text:
        return 4.0
    n = len(text)
    marks = n - len(text.translate(_MARKS))
    blanks = sum(map(text.count, " \n\t"))
    return max(2.8, min(4.6, (3.2 if kind == "code" else 4.0) - 0.8 * (marks / n) + 0.2 * (blanks / n)))


def count(text: str, kind: str = "doc", tokenizer=None) -> int:
    """Tokens by the tokenizer (anything with encode), else estimated."""
    if tokenizer is not None:
        return len(tokenizer.encode(text))
    return math.ceil(len(text) / ratio(text, kind))


class _Tiler:
    """Collects lines into blocks that tile the text."""

    def __init__(self, tokenizer):
        self.out: list[Block] = []
        self.tokenizer, self.at, self.held = tokenizer, 0, []

    def hold(self, line: str) -> None:
        self.held.append(line)

    def close(self, kind: str = "text") -> None:
        if self.held:
            text = "".join(self.held)
            self.out.append(Block(text, self.at, count(text, "code" if kind == "code" else "doc", self.tokenizer), kind))
            self.at += len(text)
            self.held = []

    def emit(self, lines: list[str], kind: str) -> None:
        self.close()
        self.held = list(lines)
        self.close(kind)


def _bare(line: str) -> str:
    return line.rstrip("\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")


def markdown_blocks(text: str, tokenizer=None) -> list[Block]:
    rows, tiler, i = text.splitlines(True), _Tiler(tokenizer), 0
    while i < len(rows):
        row = rows[i]
        if m := _OPEN.match(row):
            end = i + 1
            while end < len(rows):
                shut = _SHUT.match(_bare(rows[end]))
                end += 1
                if shut and shut[1][0] == m[1][0] and len(shut[1]) >= len(m[1]):
                    break
            tiler.emit(rows[i:end], "code")
            i = end
        elif _ATX.match(row):
            tiler.emit([row], "heading")
            i += 1
        elif row.strip() and i + 1 < len(rows) and _SETEXT.match(_bare(rows[i + 1])):
            tiler.emit(rows[i : i + 2], "heading")
            i += 2
        else:
            tiler.hold(row)
            i += 1
    tiler.close()
    return tiler.out


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def _spans(rule: str, title: str) -> bool:
    return len(_bare(rule).strip()) >= len(title.rstrip("\r\n"))


def rst_blocks(text: str, tokenizer=None) -> list[Block]:
    rows, tiler, i = text.splitlines(True), _Tiler(tokenizer), 0
    n = len(rows)

    def body(k: int, deep: Callable[[str], bool]) -> int:
        """End of the blank or deep enough lines from k on."""
        while k < n and (not rows[k].strip() or deep(rows[k])):
            k += 1
        return k

    while i < n:
        row = rows[i]
        ruled = _RULE.match(row)
        if ruled and i + 2 < n and (under := _RULE.match(rows[i + 2])) and under[1] == ruled[1] and _spans(rows[i + 2], rows[i + 1]):
            tiler.emit(rows[i : i + 3], "heading")
            i += 3
        elif row.strip() and i + 1 < n and _RULE.match(rows[i + 1]) and _spans(rows[i + 1], row):
            tiler.emit(rows[i : i + 2], "heading")
            i += 2
        elif m := _DIRECTIVE.match(_bare(row)):
            own = _indent(row)
            end = body(i + 1, lambda x, own=own: _indent(x) > own)
            tiler.emit(rows[i:end], "code" if m[1].lower() in _CODE_DIRECTIVES else "text")
            i = end
        elif row.rstrip().endswith("::"):
            first = next((_indent(x) for x in rows[i + 1 :] if x.strip()), 0)
            end = body(i + 1, lambda x, first=first: _indent(x) >= max(1, first))
            for x in rows[i:end]:
                tiler.hold(x)
            i = end
        else:
            tiler.hold(row)
            i += 1
    tiler.close()
    return tiler.out


def code_blocks(text: str, tokenizer=None) -> list[Block]:
    """A block ends with the first filled line after two blank ones, or at MAX_CODE_LINES."""
    tiler, blank = _Tiler(tokenizer), 0
    for row in text.splitlines(True):
        tiler.hold(row)
        filled = bool(row.strip())
        if filled and blank >= 2 or len(tiler.held) >= MAX_CODE_LINES:
            tiler.close("code")
            blank = 0
        else:
            blank = 0 if filled else blank + 1
    tiler.close("code")
    return tiler.out


SPLITTERS: dict[str, Callable[..., list[Block]]] = {"markdown": markdown_blocks, "md": markdown_blocks, "restructuredtext": rst_blocks, "rst": rst_blocks}


def register_splitter(fmt: str, splitter: Callable[..., list[Block]]) -> None:
    """splitter(text, tokenizer) -> blocks that tile the text; other formats are read as Markdown."""
    SPLITTERS[fmt.strip().lower()] = splitter


def _pieces(text: str, border: re.Pattern) -> list[str]:
    ends = [m.end() for m in border.finditer(text)]
    cuts = [0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _refined(b: Block, limit: int, tokenizer) -> Iterator[Block]:
    """Paragraphs of a block; too long ones as groups of sentences."""
    at = b.start
    for p in _pieces(b.text, _PARAGRAPH):
        n = count(p, "doc", tokenizer)
        if n <= limit or not _SENTENCE.search(p):
            groups = [(p, n)]
        else:
            groups = []
            for s in _pieces(p, _SENTENCE):
                m = count(s, "doc", tokenizer)
                if groups and (groups[-1][1] + m <= limit or groups[-1][1] < max(1, limit // 2)):
                    groups[-1] = (groups[-1][0] + s, groups[-1][1] + m)
                else:
                    groups.append((s, m))
        for s, m in groups:
            yield Block(s, at, m, "text")
            at += len(s)


def pack(blocks: list[Block], policy: Policy, mode: str, tokenizer=None) -> Iterator[tuple[str, int, int]]:
    """(text, start, tokens) of each chunk."""
    held: list[str] = []
    start = tokens = 0

    def done() -> tuple[str, int, int]:
        out = ("".join(held), start, tokens)
        held.clear()
        return out

    def full() -> bool:
        return tokens >= policy.target and tokens >= policy.minimum

    for b in blocks:
        if held and b.kind == "heading" and tokens >= max(1, policy.minimum // 2):
            yield done()
        over = tokens + b.tokens - policy.target
        if not held:
            held, start, tokens = [b.text], b.start, b.tokens
            if full():
                yield done()
        elif over <= 0 or tokens < policy.minimum:
            held.append(b.text)
            tokens += b.tokens
        elif over <= policy.target - tokens:
            held.append(b.text)
            tokens += b.tokens
            yield done()
        else:
            last = done()
            yield last
            tail = ""
            if policy.overlap:
                size = int(policy.overlap * ratio(last[0], mode))
                tail = last[0][-size:] if size else ""
                if len(last[0]) <= size:
                    tail = last[0]
            if policy.overlap:
                held, start, tokens = [tail, b.text], last[1] + len(last[0]) - len(tail), count(tail, mode, tokenizer) + b.tokens
            else:
                held, start, tokens = [b.text], b.start, b.tokens
            if full():
                yield done()
    if held:
        yield done()


def chunks(text: str, mode: str = "doc", fmt: str | None = None, policy: Policy = Policy(), tokenizer=None) -> list[tuple[str, int, int]]:
    """(text, start, tokens) of each chunk of a text; none for the empty text."""
    if mode == "code":
        blocks = code_blocks(text, tokenizer)
    else:
        blocks = SPLITTERS.get((fmt or "markdown").lower(), markdown_blocks)(text, tokenizer)
        if policy.semantic:
            blocks = [x for b in blocks for x in (_refined(b, policy.block_limit, tokenizer) if b.kind == "text" and b.tokens > policy.block_limit else [b])]
    return list(pack(blocks, policy, mode, tokenizer))


def chunk(docs: DataFrame, text: str = "text", mode: str | None = None, fmt: str | None = None, policy: Policy = Policy()) -> DataFrame:
    """docs with a row for each chunk: text, chunk_id (from 1), n_chunks, start, end, tokens; other columns repeat.

    mode, fmt: names of columns.  A null or empty text has no chunks and no rows.  One Arrow pass, no shuffle; memory is bounded by a run of texts.
    """
    t = F.col(text)
    keep = [c for c in docs.columns if c != text]
    rows = docs.where(t.isNotNull() & (t != "")).select(F.struct(*(keep or [F.lit(0)])).alias("k"), t.alias("t"), (F.col(mode) if mode else F.lit("doc")).alias("m"), (F.col(fmt) if fmt else F.lit("markdown")).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, modes, fmts = b.column("t"), b.column("m"), b.column("f")
            at, found, held = [], [], 0
            for i in range(len(b)):
                x = texts[i].as_py()
                own = chunks(x, modes[i].as_py() or "doc", fmts[i].as_py(), policy)
                at += [i] * len(own)
                found += [(c, n, len(own), start, start + len(c), tokens) for n, (c, start, tokens) in enumerate(own, 1)]
                held += len(x)
                if held >= RUN or i == len(b) - 1:
                    made = [pa.array(v, kind) for v, kind in zip(zip(*found, strict=True), KINDS, strict=True)] if found else [pa.array([], kind) for kind in KINDS]
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), *made], ["k", "t", "chunk_id", "n_chunks", "start", "end", "tokens"])
                    at, found, held = [], [], 0

    out = rows.mapInArrow(run, StructType([rows.schema["k"], *(StructField(n, IntegerType() if n != "t" else StringType()) for n in ("t", "chunk_id", "n_chunks", "start", "end", "tokens"))]))
    return out.select(*[F.col("k")[c].alias(c) for c in keep], F.col("t").alias(text), "chunk_id", "n_chunks", "start", "end", "tokens")
