"""Substring deduplication with suffix automata of reference passages.

Words are what white space parts.  A passage of at least ``min_words`` words
that an earlier document (smaller doc_id) holds too is removed; its first
document keeps it.

1. Anchors: hashes of ``ANCHOR``-grams of words, winnowed so that every run of
   min_words words contains one (and its copies contain the same one).  Anchors
   of a single document are dropped.
2. Windows: hashes of the runs of min_words words around the other anchors.  A
   repeated run contains a shared anchor, so no repeat is left out.  The owner
   of a window is the least doc_id that holds it; each later holder has a hit.
   Windows are sorted and read as a stream, so a hot window costs no memory.
3. Reference shards: for each owner, the windows it owns, as maximal passages.
4. A generalised suffix automaton over words is built per shard.  The regions
   of a document that its hits cover are streamed through the automaton of their
   owner; matching statistics give, at each word, the longest match that ends
   there, and the maximal matches of min_words words or more are removed.

A row is known by its doc_id and the hash of its text, so what is cut from one row
never touches another row that repeats the id.

Every window has an owner of its own, so what goes is exactly what an earlier
document holds in runs of min_words words, also where an earlier document holds
a shorter piece of a passage.  A region is cut by owners, so where the owner
changes from word to word, a word is read up to min_words times.

Shards whose total size, as measured, is below ``BROADCAST_BYTES`` are
broadcast.  Beyond that, shards and regions are sent to tasks by owner, with a salt for each
``REGIONS`` regions of an owner, and streamed in order with a shard ahead of its
regions.  In both forms a task meets an owner's regions in a row and holds one automaton at a time.

Defined cases: null texts, and rows with a null doc_id, pass unchanged and are no
reference.  Texts of fewer than min_words words pass unchanged.  Rows that
repeat a doc_id never match each other, but each is compared with smaller ids by its own text.
A text removed as a whole becomes the empty text, the row stays.  A removed span takes the white space
after it along.  Ties between places in an owner go to the smaller text hash and position.  All other
columns pass through, whatever they are called; ``count`` must name a new one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.work import BROADCAST_BYTES, Workspace, fresh, small

MIN_WORDS = 50
ANCHOR = 32
#: Regions of one owner that share a copy of its shard where shards are too large to broadcast.
REGIONS = 2000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def anchors(data: np.ndarray, off: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the winnowed k-grams: of every min_words words in a row, the k-grams of least hash."""
    s, _, h = tk.words(data, off, raw=True)
    row = tk.rows_of(s, off)
    w = min_words - k + 1
    g = tk.grams(h, k)
    if len(h) < min_words:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    least = tk.sliding(g, w)
    inside = row[: len(least)] == row[min_words - 1 :][: len(least)]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    best = tk.sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero((g == best) & (row[: len(g)] == row[k - 1 :][: len(g)]))
    return row[at], at - np.searchsorted(row, row[at]), g[at]


def _anchor_rows(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            data, off = tk.utf8(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in tk.runs(off):
                row, pos, g = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], min_words, k)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[i + row]), pa.array(pos.astype(np.int32))], ["anchor", "doc_id", "pos"])

    return docs.mapInArrow(run, "anchor long, doc_id long, pos int")


def _window_rows(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """window, doc_id, tid, pos: the runs of min_words words that contain one of the anchors at the positions ``at``."""

    def run(batches):
        for b in batches:
            data, off = tk.utf8(b.column("text"))
            ids, tids = _columns(b, "doc_id", "tid")
            place = b.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(b.column("at")).to_numpy(zero_copy_only=False))])
            for i, j in tk.runs(off):
                s, _, h = tk.words(data[off[i] : off[j]], off[i : j + 1] - off[i], raw=True)
                row = tk.rows_of(s, off[i : j + 1] - off[i])
                g = tk.grams(h, min_words)
                if not len(g):
                    continue
                first = np.searchsorted(row, np.arange(j - i + 1))
                r, p = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), place[ends[i] : ends[j]]
                # anchors are known by doc_id: where that repeats, positions beyond this text's words are another's
                inside = p + k <= first[r + 1] - first[r]
                r, p = r[inside], p[inside]
                near = tk.counts(np.maximum(p + k - min_words, 0) + first[r], len(h) + 1) - tk.counts(p + first[r] + 1, len(h) + 1)
                at = np.flatnonzero((np.cumsum(near)[: len(g)] > 0) & (row[: len(g)] == row[min_words - 1 :]))
                r = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[i + r]), pa.array(tids[i + r]), pa.array((at - first[r]).astype(np.int32))], ["window", "doc_id", "tid", "pos"])

    return docs.mapInArrow(run, "window long, doc_id long, tid long, pos int")


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


HITS = "doc_id long, tid long, owner long, otid long, pos int"


def _owners(batches):
    """Windows in order of (window, doc_id, tid, pos) -> HITS: of each later holder, and of the owner's first place (as its own owner)."""
    last, held, hit0 = None, (0, 0, 0), False
    for b in batches:
        w, d, t, p = _columns(b, "window", "doc_id", "tid", "pos")
        if not len(w):
            continue
        new = np.concatenate([[last is None or w[0] != last], w[1:] != w[:-1]])
        group = np.cumsum(new)
        owner, otid, place = (np.concatenate([[h], x[new]])[group] for h, x in zip(held, (d, t, p), strict=True))
        hit = d != owner
        first = hit & ~np.concatenate([[hit0 and not new[0]], hit[:-1]])
        last, held, hit0 = w[-1], (owner[-1], otid[-1], place[-1]), hit[-1]
        out = [np.concatenate(x) for x in ((d[hit], owner[first]), (t[hit], otid[first]), (owner[hit], owner[first]), (otid[hit], otid[first]), (p[hit], place[first]))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4].astype(np.int32))], ["doc_id", "tid", "owner", "otid", "pos"])


def _ranges(batches, min_words):
    """HITS in order of their columns -> doc_id, tid, owner, otid, start, stop of the words that windows cover without a gap."""
    open_ = None
    for b in batches:
        *keys, p = _columns(b, "doc_id", "tid", "owner", "otid", "pos")
        if not len(p):
            continue
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0) | (p[1:] > p[:-1] + min_words)])
        at = np.flatnonzero(new)
        rows = [list(x) for x in zip(*(k[at].tolist() for k in keys), p[at].tolist(), (p[np.append(at[1:], len(p)) - 1] + min_words).tolist(), strict=True)]
        if open_ is not None:
            if open_[:4] == rows[0][:4] and rows[0][4] <= open_[5]:
                rows[0][4] = open_[4]
            else:
                rows.insert(0, open_)
        open_ = rows.pop()
        yield _range_batch(rows)
    if open_ is not None:
        yield _range_batch([open_])


def _range_batch(rows) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "tid": pa.int64(), "owner": pa.int64(), "otid": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self._last = 0

    def add(self, sequence) -> None:
        self._last = 0
        for c in sequence:
            self._extend(c)

    def _split(self, p: int, c, q: int) -> int:
        clone = len(self.len)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, c) -> None:
        p = self._last
        q = self.next[p].get(c)
        if q is not None:
            self._last = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
            return
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[p] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        self._last = cur

    def statistics(self, sequence):
        """Length of the longest match that ends at each position."""
        state = size = 0
        nxt, link, length = self.next, self.link, self.len
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                size += 1
            yield size

    def spans(self, sequence, least: int) -> list[tuple[int, int]]:
        """Union of the maximal matches of ``least`` symbols or more, as ranges."""
        out: list[list[int]] = []
        for i, size in enumerate(self.statistics(sequence)):
            if size >= least:
                a = i + 1 - size
                if out and a <= out[-1][1]:
                    out[-1][0], out[-1][1] = min(out[-1][0], a), i + 1
                else:
                    out.append([a, i + 1])
        return [(a, b) for a, b in out]


def automaton(passages: str) -> SuffixAutomaton:
    """Of a shard: passages end at line feeds, words at spaces."""
    made = SuffixAutomaton()
    for p in passages.split("\n"):
        made.add(p.split(" "))
    return made


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    s, e = tk.spans(~tk.SPACE[data], np.array([0, len(data)]))
    return s, e, raw


PIECES = "owner long, otid long, doc_id long, tid long, start int, words string"


def _pieces(batches, min_words):
    """Rows of a document with its ranges by owner -> its shard (doc_id null) and its regions by owner."""
    for b in batches:
        out = []
        for doc, tid, text, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tid", "text", "ranges")), strict=True):
            s, e, raw = _word_bounds(text)
            own = []
            for r in sorted(ranges, key=lambda r: (r["start"], r["stop"])):
                a, z = r["start"], r["stop"]
                words = b" ".join([raw[x:y] for x, y in zip(s[a:z].tolist(), e[a:z].tolist(), strict=True)]).decode("utf-8", "surrogatepass")
                if (r["owner"], r["otid"]) == (doc, tid):
                    own.append(words)
                else:
                    out.append((r["owner"], r["otid"], doc, tid, a, words))
            if own:
                out.append((doc, tid, None, None, 0, "\n".join(own)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((*[pa.int64()] * 4, pa.int32(), pa.string()))], ["owner", "otid", "doc_id", "tid", "start", "words"])


SPANS = "doc_id long, tid long, start int, stop int"


def _match(batches, min_words):
    """Regions in order of their owner, each with the shard or after it (a row without doc_id) -> SPANS."""
    shard, made = None, None
    for b in batches:
        out = []
        for doc, tid, start, text, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tid", "start", "words", "shard")), strict=True):
            if own is not None and own != shard:
                shard, made = own, automaton(own)
            if doc is not None:
                out += [(doc, tid, start + a, start + z) for a, z in made.spans(text.split(" "), min_words)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "tid", "start", "stop"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tid (hash of the text), text of the rows that take part."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")).where("doc_id is not null and text is not null")


def repeated_spans(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """SPANS: ranges of words that repeat a passage of an earlier document, as maximal matches.  tid is xxhash64 of the row's text."""
    if not 1 <= anchor <= min_words:
        raise ValueError("anchor must lie in 1..min_words")
    ws = Workspace(spark, "substring")
    texts = keyed(docs)
    found = ws.table(_anchor_rows(texts, min_words, anchor), "anchors")
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    several = ws.table(several, "several")
    at = found.join(several, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    at = ws.table(at, "at")
    ws.drop("anchors")
    wanted = texts.join(small(at.select("doc_id"), 16), "doc_id", "left_semi")
    windows = _window_rows(wanted.join(at, "doc_id").select("doc_id", "tid", "text", "at"), min_words, anchor)
    held = windows.repartition("window").sortWithinPartitions("window", "doc_id", "tid", "pos").mapInArrow(_owners, HITS)
    ranges = held.repartition("doc_id", "tid").sortWithinPartitions("doc_id", "tid", "owner", "otid", "pos").mapInArrow(lambda b: _ranges(b, min_words), "doc_id long, tid long, owner long, otid long, start int, stop int")
    marks = ws.table(ranges.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("owner", "otid", "start", "stop")).alias("ranges")), "marks")
    ws.drop("at")
    wanted = texts.join(small(marks.select("doc_id", "tid"), 24), ["doc_id", "tid"], "left_semi")
    pieces = wanted.join(marks, ["doc_id", "tid"]).select("doc_id", "tid", "text", "ranges").mapInArrow(lambda b: _pieces(b, min_words), PIECES)
    pieces = ws.table(pieces, "pieces")
    shards = pieces.where("doc_id is null").select("owner", "otid", F.col("words").alias("shard")).dropDuplicates(["owner", "otid"])  # a row may be repeated
    shards = ws.table(shards, "shards")
    size = shards.agg(F.sum(F.octet_length("shard") + 32)).first()[0] or 0
    regions = pieces.where("doc_id is not null")
    columns = ["doc_id", "tid", "start", "words", "shard"]
    if size <= BROADCAST_BYTES:
        stream = regions.sortWithinPartitions("owner", "otid").join(F.broadcast(shards), ["owner", "otid"]).select(*columns)
    else:
        salts = ws.table(regions.groupBy("owner", "otid").agg(F.ceil(F.count("*") / REGIONS).cast("int").alias("salts")), "salts")
        heads = shards.join(salts, ["owner", "otid"]).select("owner", "otid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("tid", "long"), ("start", "int"), ("words", "string"))], "shard")
        rest = regions.join(salts, ["owner", "otid"]).select("owner", "otid", F.pmod(F.xxhash64("doc_id", "tid", "start"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "tid", "start", "words", F.lit(None).cast("string").alias("shard"))
        key = ["owner", "otid", "salt"]
        stream = heads.unionByName(rest).repartition(*key).sortWithinPartitions(*key, "kind").select(*columns)
    return stream.mapInArrow(lambda b: _match(b, min_words), SPANS)


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without these ranges of words, and the number of words taken out."""
    s, _, raw = _word_bounds(text)
    n, gone, at, out = len(s), 0, 0, []
    for a, b in sorted(ranges):
        b = min(b, n)
        a = min(max(a, 0), b)
        begin, end = (int(s[a]) if a < n else len(raw)), (int(s[b]) if b < n else len(raw))
        if end <= at:
            continue
        begin = max(begin, at)
        out.append(raw[at:begin])
        gone += int(np.searchsorted(s, end) - np.searchsorted(s, begin))
        at = end
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), gone


def remove_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, count: str | None = None) -> DataFrame:
    """docs with repeated passages cut from text; ``count`` names a new column for the words removed.  An integer column n_chars follows the text."""
    if count is not None and count.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {count} already")
    ws = Workspace(spark, "substring-cut")
    key, tid, ranges = fresh(docs, "cut_id"), fresh(docs, "cut_tid"), fresh(docs, "cut_ranges")
    spans = repeated_spans(spark, docs, min_words, anchor).groupBy(F.col("doc_id").alias(key), F.col("tid").alias(tid)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(ranges))
    spans = ws.table(spans, "spans")
    schema = docs.schema if count is None else docs.select("*", F.lit(0).cast("int").alias(count)).schema
    size = spans.agg(F.sum(F.size(ranges) * 8 + 40)).first()[0] or 0
    same = (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(tid))
    joined = docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, same, "left").drop(key, tid)
    columns = docs.columns
    text_at, n_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches):
        for b in batches:
            spans_at = b.schema.get_field_index(ranges)
            marked = b.column(spans_at)
            arrays = [b.column(i) for i in range(len(columns))]
            gone = np.zeros(len(b), np.int32)
            hit = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False) & arrays[text_at].is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                at = pa.array(hit)
                texts = []
                for t, r in zip(arrays[text_at].take(at).to_pylist(), marked.take(at).to_pylist(), strict=True):
                    texts.append(cut(t, [(x["start"], x["stop"]) for x in r]))
                gone[hit] = [g for _, g in texts]
                mask = np.zeros(len(b), bool)
                mask[hit] = True
                mask = pa.array(mask)
                arrays[text_at] = pa.compute.replace_with_mask(arrays[text_at], mask, pa.array([t for t, _ in texts], arrays[text_at].type))
                if n_at >= 0 and pa.types.is_integer(arrays[n_at].type):
                    arrays[n_at] = pa.compute.replace_with_mask(arrays[n_at], mask, pa.array([len(t) for t, _ in texts], arrays[n_at].type))
            names = list(columns)
            if count is not None:
                arrays.append(pa.array(gone))
                names.append(count)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.select(*[docs[c] for c in columns], ranges).mapInArrow(run, schema)
