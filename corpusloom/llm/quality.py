"""Quality rules: a conditional random field labels each line content or boilerplate.

The field is trained on a bounded sample of documents that ``labels`` rates
(``TRAIN_DOCS`` of them, in order of a hash of the id).  A rating is about a
document, so its lines' labels are latent and found by hard expectation
maximisation (``line_labels``): every line starts with its document's rating,
the model is fitted to lines on their own, then lines are labelled anew by it, under the
constraint that the labels bear out the rating (the share of words in content
lines reaches ``min_share`` if, and only if, the document is rated good; otherwise its lines
keep the rating).  The last rounds fit and decode whole sequences, so that transitions are learnt between
lines of unlike labels.  Decoding reads every line of every document in one Arrow
pass; a document is kept if the share of its words in content lines reaches
``min_share``; a share equal to it is enough.

Defined cases: a null or blank text has no lines, share 0, and is rejected.
Lines end at LF or CR; blank lines don't count.  Rows with a null doc_id or
repeated rows are judged each on its own text.  Without usable labels (no rows,
or one rating only) every line is content, so every text with a word is kept.
Other columns pass through the filter untouched, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import crf
from corpusloom.llm import textkit as tk

#: Bound of the labelled sample that the field is fitted on; documents.
TRAIN_DOCS = 2000
#: Training sequences are cut to so many lines; decoding never cuts.
TRAIN_LINES = 64
MIN_SHARE = 0.5
#: Rounds of labelling: of lines on their own, then of sequences.
LINE_ROUNDS, SEQUENCE_ROUNDS = 2, 1
L2 = 0.1
FEATURES = 18

_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_LETTER = tk.ALNUM.copy()
_LETTER[48:58] = False
_UP = np.zeros(256, bool)
_UP[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[i for i in range(33, 127) if not tk.ALNUM[i] and chr(i) not in ".,;:'\"?!-()|"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"'"]] = True


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line that has a word: its row, its number of words, its features (float32)."""
    ls, le = tk.spans(_LINE[data], off)
    ws, we = tk.spans(~tk.SPACE[data], off)
    line = np.searchsorted(ls, ws, "right") - 1
    n_words = tk.counts(line, len(ls))
    good = n_words > 0
    if not good.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    wh = tk.hash_spans(data, ws, we)
    renumber = np.cumsum(good) - 1
    line, ls, le, n = renumber[line], ls[good], le[good], n_words[good].astype(np.float64)
    k, row = len(ls), tk.rows_of(ls, off)

    def total(table):
        return np.add.reduceat(table[data], ls, dtype=np.int32).astype(np.float64)

    size = (le - ls).astype(np.float64)
    letters, upper = total(_LETTER), total(_UP)
    symbols, digits = total(_SYMBOL), total(_DIGIT)
    shout, pipe = np.add.reduceat(data == 33, ls, dtype=np.int32), np.add.reduceat(data == 124, ls, dtype=np.int32)
    again = (wh[1:] == wh[:-1]) & (line[1:] == line[:-1])
    stutter = tk.counts(line[1:][again], k) / n
    order = np.lexsort((wh, line))
    a, b = wh[order], line[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = tk.counts(b[first], k) / n
    sums = np.add.reduceat(tk.mix(wh + np.uint64(1)) * (2 * (np.arange(len(wh)) - np.searchsorted(line, line)) + 1).astype(np.uint64), np.searchsorted(line, np.arange(k)))
    echo = np.zeros(k)
    echo[1:] = (sums[1:] == sums[:-1]) & (row[1:] == row[:-1])
    echo[:-1] = np.maximum(echo[:-1], echo[1:])
    last = _END[data[we[np.searchsorted(line, np.arange(k), "right") - 1] - 1]]
    x = np.stack(
        [
            np.ones(k), upper / np.maximum(letters, 1), np.minimum(1, 5 * symbols / size), np.minimum(1, shout / n), np.minimum(1, pipe / n), digits / size,
            stutter, echo, n < 3, n >= 8, np.minimum(1, size / n / 20), last, letters / size, upper > 0.5 * letters, symbols > 0.05 * size, pipe > 0.25 * n, stutter > 0.2, distinct,
        ],
        axis=1,
    ).astype(np.float32)
    return row, n.astype(np.int64), x


def decode(data: np.ndarray, off: np.ndarray, model: crf.Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line that has a word: its row, its number of words, its label (1: content)."""
    row, size, x = line_features(data, off)
    score = (x.astype(np.float64) @ np.array(model.w)).tolist()
    cut = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
    return row, size, np.array([v for a, b in zip(cut, cut[1:], strict=False) for v in crf.viterbi(score[a:b], model)], np.int64)


def shares(texts: pa.Array, model: crf.Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: lines, content lines, share of the words in content lines."""
    data, off = tk.utf8(texts)
    n = len(off) - 1
    lines, content, share = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for i, j in tk.runs(off):
        row, size, y = decode(data[off[i] : off[j]], off[i : j + 1] - off[i], model)
        if len(row):
            lines[i:j], content[i:j] = tk.counts(row, j - i), np.bincount(row, y, j - i)
            share[i:j] = np.bincount(row, size * y, j - i) / np.maximum(1, np.bincount(row, size, j - i))
    return lines, content, share


def line_labels(documents: list[tuple[int, np.ndarray, np.ndarray]], min_share: float = MIN_SHARE) -> tuple[crf.Model, list[np.ndarray]]:
    """The fitted field and the labels of each document's lines; documents are (rating, features, words of each line)."""
    y = [np.full(len(n), int(q > 0)) for q, _, n in documents]

    def fitted(length):
        return crf.train([(x[i : i + length], v[i : i + length]) for (_, x, _), v in zip(documents, y, strict=True) for i in range(0, len(v), length)], FEATURES, L2)

    for k in range(LINE_ROUNDS + SEQUENCE_ROUNDS):
        model = fitted(1 if k < LINE_ROUNDS else TRAIN_LINES)
        if not model.trained:
            return model, y
        w = np.array(model.w)
        for i, (q, x, n) in enumerate(documents):
            new = (x @ w + model.start >= 0).astype(int) if k < LINE_ROUNDS else np.array(crf.viterbi((x @ w).tolist(), model))
            bears_out = len(n) and ((n * new).sum() >= min_share * n.sum()) == (q > 0)
            y[i] = new if bears_out else np.full(len(n), int(q > 0))
    return fitted(TRAIN_LINES), y


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE) -> crf.Model:
    """Fits the field on at most train_docs labelled documents (the documented bound)."""
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rated = F.broadcast(rated)  # train_docs rows at most

    def features(batches):
        for b in batches:
            data, off = tk.utf8(b.column("text"))
            out, words = [np.zeros(0, np.float32)] * len(b), [np.zeros(0, np.int64)] * len(b)
            for i, j in tk.runs(off):
                row, n, x = line_features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for r in np.unique(row):
                    out[i + r], words[i + r] = x[row == r], n[row == r]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), *(pa.array([v.tobytes() for v in c], pa.binary()) for c in (out, words))], ["doc_id", "quality", "x", "n"])

    got = texts.join(rated, "doc_id").select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, x binary, n binary").collect()
    documents = [(int(r.quality > 0), np.frombuffer(r.x, np.float32).reshape(-1, FEATURES).astype(np.float64), np.frombuffer(r.n, np.int64)) for r in sorted(got, key=lambda r: (r.doc_id, r.x))]
    return line_labels([d for d in documents if len(d[2])], min_share)[0]


def label_lines(docs: DataFrame, model: crf.Model, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_lines, n_content_lines, content_share, keep for every row of docs."""

    def decide(batches):
        for b in batches:
            lines, content, share = shares(b.column("text"), model)
            keep = (lines > 0) & (share >= min_share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines), pa.array(content), pa.array(share), pa.array(keep)], ["doc_id", "n_lines", "n_content_lines", "content_share", "keep"])

    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return only.mapInArrow(decide, "doc_id long, n_lines long, n_content_lines long, content_share double, keep boolean")


def quality_filter(docs: DataFrame, model: crf.Model, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that are kept, with all their columns, in one pass without a shuffle."""

    def keep(batches):
        for b in batches:
            lines, _, share = shares(b.column(b.schema.get_field_index("text")).cast(pa.string()), model)
            yield b.filter(pa.array((lines > 0) & (share >= min_share)))

    return docs.mapInArrow(keep, docs.schema)
