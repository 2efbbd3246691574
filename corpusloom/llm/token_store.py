"""Token ids as single zstandard frames with one shared dictionary.

Each document's ids are serialised as little-endian uint16 (uint32 for larger
vocabularies) and compressed alone, so a short document is read without its
neighbours; the dictionary gives it the context that a short array lacks.  Every row carries the
dictionary's hash and the frame's place (shard, offset, length).

The dictionary is trained on all documents, by levels: each block of about ``BLOCK_BYTES`` of serialised ids is
trained to a small dictionary where it lies; these, cut into pieces, are the samples of the next level, until
they fit into one block, whose dictionary is the shared one.  Each level is less than a hundredth of the one below.

A shard is what one task stores: frames keep the order of its rows and offsets are a running sum, so nothing is shuffled.
``write`` puts each shard into one flat file (by the name of the task's attempt, so a task that is run
again never touches a file that rows point to) with the rows as its index, sorted by doc_id; ``lookup`` and ``fetch`` read only the
index rows and byte ranges of the documents they are asked for.

Defined cases: a null text has no tokens of its own: its frame and count are
null and its length 0.  An empty text has 0 tokens and a frame.  A null doc_id is stored, but can't be looked up.
Rows that repeat a doc_id are stored one by one, and looked up together.
Where there is too little to train on (zstandard wants several samples), the dictionary is empty and frames stand alone;
an empty table yields only the dictionary's row.  Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import VOCABULARY
from corpusloom.llm.work import Workspace, parts, small

DICTIONARY_BYTES = 1 << 16
#: Serialised ids that one dictionary of the first level, and samples that one of the next levels is trained on.
BLOCK_BYTES = 4 << 20
#: Size of the dictionaries below the last level, and of the pieces they are cut into.
LOCAL_BYTES, PIECE_BYTES = 1 << 15, 256
#: Longer arrays are cut into samples of so many bytes for training.
SAMPLE_BYTES = 1 << 14
LEVEL = 3
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def serialise(text: str, path: str = VOCABULARY) -> bytes:
    enc = _tokenizer(path)
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u2" if enc.max_token_value < 1 << 16 else "<u4").tobytes()


def deserialise(raw: bytes, path: str = VOCABULARY) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if _tokenizer(path).max_token_value < 1 << 16 else "<u4")


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


@lru_cache(4)
def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    if not raw:
        return None
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)


@lru_cache(4)
def _compressor(raw: bytes) -> zstd.ZstdCompressor:
    d = _dictionary(raw)
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=True)


def compress(raw: bytes, dictionary: bytes) -> bytes:
    return _compressor(dictionary).compress(raw)


def decompress(frame: bytes, dictionary: bytes) -> bytes:
    return zstd.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, empty if there is too little to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=200, d=8, f=18, accel=2, split_point=1.0, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b""


def _pieces(samples: list[bytes], size: int) -> list[bytes]:
    """What a block hands on: its dictionary of ``size`` bytes in pieces; where zstandard makes none (too few or degenerate samples), its distinct pieces up to that size."""
    cut = [x[i : i + SAMPLE_BYTES] for x in samples for i in range(0, len(x), SAMPLE_BYTES)]
    made = train(cut, size)
    if made:
        return [made[i : i + PIECE_BYTES] for i in range(0, len(made), PIECE_BYTES)]
    out, have = [], 0
    for x in sorted({x[i : i + PIECE_BYTES] for x in cut for i in range(0, len(x), PIECE_BYTES)}):
        have += len(x)
        if have > size:
            break
        out.append(x)
    return out


def _level(samples: DataFrame, block: int, local: int) -> DataFrame:
    """One level of training: a column of bytes -> a column ``piece`` of at most ``local`` bytes a block."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= block:
                    out += _pieces(held, local)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])
        yield pa.RecordBatch.from_arrays([pa.array(_pieces(held, local) if held else [], pa.binary())], ["piece"])

    return samples.mapInArrow(run, "piece binary")


def train_dictionary(ws: Workspace, ids: DataFrame, size: int = DICTIONARY_BYTES, block: int = BLOCK_BYTES) -> bytes:
    """The shared dictionary of a table with serialised ids in the column ``ids``."""
    local = min(LOCAL_BYTES, block // 16)  # so each level is smaller than the one below
    pieces, k = ws.table(_level(ids.where("octet_length(ids) > 0").select("ids"), block, local), "pieces-0"), 0
    while (total := pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) > block:
        k += 1
        spread = pieces.repartition(parts(total, block), F.xxhash64("piece"))
        pieces = ws.table(_level(spread, block, local), f"pieces-{k}")
    return train(sorted(bytes(r.piece) for r in pieces.collect()), size)  # BLOCK_BYTES at most


def _ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (serialised; null for a null text)."""

    def run(batches):
        width = None
        for b in batches:
            width = width or deserialise(b"\0" * 8, path).itemsize
            raw = [None if t is None else serialise(t, path) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if r is None else len(r) // width for r in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


def _frames(ids: DataFrame, shared, digest: str, folder: str | None = None) -> DataFrame:
    """The documents' rows; with a folder, frames go to flat files there and rows tell the file instead of the frame."""

    def run(batches):
        dictionary, task, at, out = shared.value, TaskContext.get(), 0, None
        shard = task.partitionId()
        name = f"{shard:06d}-{task.taskAttemptId()}.frames"
        try:
            for b in batches:
                frames = [None if raw is None else compress(raw, dictionary) for raw in b.column("ids").to_pylist()]
                length = np.array([len(f) if f is not None else 0 for f in frames], np.int64)
                offset = at + np.cumsum(length) - length
                at += int(length.sum())
                n = len(frames)
                if folder is not None and n:
                    if out is None:
                        fs, root = _filesystem(folder)
                        out = fs.open_output_stream(f"{root}/{name}")
                    out.write(b"".join(f for f in frames if f is not None))
                last = pa.array([name] * n, pa.string()) if folder is not None else pa.array(frames, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([digest] * n, pa.string()), pa.array(np.full(n, shard, np.int32)), b.column("doc_id"), pa.array(offset), pa.array(length), b.column("n_tokens"), last], ["dictionary_hash", "shard", "doc_id", "offset", "length", "n_tokens", "file" if folder is not None else "frame"])
        finally:
            if out is not None:
                out.close()

    return ids.mapInArrow(run, f"dictionary_hash string, shard int, doc_id long, offset long, length long, n_tokens long, {'file string' if folder is not None else 'frame binary'}")


def _prepared(spark: SparkSession, docs: DataFrame, path: str, dictionary: bytes | None):
    ws = Workspace(spark, "tokens")
    ids = ws.table(_ids(docs, path), "ids")
    if dictionary is None:
        dictionary = train_dictionary(ws, ids)
    return ids, dictionary, spark.sparkContext.broadcast(dictionary), dictionary_hash(dictionary)  # DICTIONARY_BYTES at most


def store(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY, dictionary: bytes | None = None) -> DataFrame:
    """The dictionary (one row of kind 'dictionary') and every document's frame with its place."""
    ids, dictionary, shared, digest = _prepared(spark, docs, path, dictionary)
    rows = _frames(ids, shared, digest).select(F.lit("document").alias("kind"), "*")
    head = spark.createDataFrame([("dictionary", digest, None, None, 0, len(dictionary), None, bytearray(dictionary))], rows.schema)
    return head.unionByName(rows)


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str = VOCABULARY, dictionary: bytes | None = None) -> DataFrame:
    """Stores flat shards, their index and the dictionary below ``folder`` (shared by all executors); the index."""
    ids, dictionary, shared, digest = _prepared(spark, docs, path, dictionary)
    folder = folder.rstrip("/")
    fs, root = _filesystem(folder)
    fs.create_dir(f"{root}/shards", recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    rows = Workspace(spark, "token-index").table(_frames(ids, shared, digest, f"{folder}/shards"), "rows")  # files are written once
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _stored_dictionary(folder: str, digest: str | None = None) -> bytes:
    fs, root = _filesystem(folder.rstrip("/"))
    with fs.open_input_stream(f"{root}/dictionary") as f:
        raw = f.read()
    if digest is not None and dictionary_hash(raw) != digest:
        raise ValueError("the dictionary doesn't fit its hash")
    return raw


def _ranges(folder: str, rows, dictionary: bytes, path: str):
    """(doc_id, ids or None) of index rows (doc_id, file, offset, length, n_tokens), by range reads."""
    fs, root = _filesystem(folder.rstrip("/") + "/shards")
    name, f = None, None
    try:
        for doc, file, offset, length, n in rows:
            if n is None:
                yield doc, None
                continue
            if file != name:
                if f is not None:
                    f.close()
                name, f = file, fs.open_input_file(f"{root}/{file}")
            yield doc, deserialise(decompress(f.read_at(length, offset), dictionary), path)
    finally:
        if f is not None:
            f.close()


def lookup(spark: SparkSession, folder: str, doc_ids: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and token_ids of the stored documents among doc_ids; of the flat files only their byte ranges are read."""
    wanted = Workspace(spark, "token-lookup").table(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "ids")
    index = spark.read.parquet(f"{folder.rstrip('/')}/index").join(small(wanted, 16), "doc_id", "left_semi")
    first = spark.read.parquet(f"{folder.rstrip('/')}/index").select("dictionary_hash").first()
    shared = spark.sparkContext.broadcast(_stored_dictionary(folder, first.dictionary_hash if first else None))

    def run(batches):
        for b in batches:
            got = list(_ranges(folder, zip(*(b.column(c).to_pylist() for c in ("doc_id", "file", "offset", "length", "n_tokens")), strict=True), shared.value, path))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return index.sortWithinPartitions("file", "offset").select("doc_id", "file", "offset", "length", "n_tokens").mapInArrow(run, "doc_id long, token_ids array<int>")


def fetch(spark: SparkSession, folder: str, doc_id: int, path: str = VOCABULARY) -> list[np.ndarray | None]:
    """The ids of one document (of each row of that id), read by the driver: the index is sorted, so the filter prunes its row groups."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/index").where(F.col("doc_id") == doc_id).orderBy("file", "offset").collect()
    if not rows:
        return []
    dictionary = _stored_dictionary(folder, rows[0].dictionary_hash)
    return [x for _, x in _ranges(folder, [(r.doc_id, r.file, r.offset, r.length, r.n_tokens) for r in rows], dictionary, path)]


def read(stored: DataFrame, doc_ids: DataFrame | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id and token_ids of the stored documents, or of those in doc_ids only.  A frame of another dictionary is an error."""
    head = stored.where("kind = 'dictionary'").select("dictionary_hash", "frame").first()
    dictionary, digest = bytes(head.frame), head.dictionary_hash
    if dictionary_hash(dictionary) != digest:
        raise ValueError("the dictionary doesn't fit its hash")
    rows = stored.where("kind = 'document'").select("doc_id", "dictionary_hash", "frame")
    if doc_ids is not None:
        rows = rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            out = []
            for h, f in zip(b.column("dictionary_hash").to_pylist(), b.column("frame").to_pylist(), strict=True):
                if h != digest:
                    raise ValueError("a frame of another dictionary")
                out.append(None if f is None else deserialise(decompress(f, dictionary), path).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return rows.mapInArrow(run, "doc_id long, token_ids array<int>")
