import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm import token_store as ts
from corpusloom.llm import tokenize as tz


@pytest.fixture(scope="module")
def truth():
    with open(tz.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=ts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    data, off = tk.utf8(pa.array(texts, pa.string()))
    ids, ends = tz.encoder().encode(data, off)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


SAMPLES = ["", " ", "  \n\n x", "don't we'll I'VE 's", "naïve façade — Ωμέγα 漢字かな 👩‍👩‍👧", "a" * 300, "1234567 89", "x  y", "\t\tif (x) {\n  }", "'’s it's", "  leading", "trail  ", "\r\n\r\n", "ÀÉÎ", "''''s", "a's b't"]


def test_equals_the_library(truth):
    assert encode(SAMPLES) == [truth.encode_ordinary(s) for s in SAMPLES]


def test_equals_the_library_on_the_documents(truth, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert encode(texts) == [truth.encode_ordinary(t) for t in texts]


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(deadline=None, max_examples=300)
def test_equals_the_library_on_any_text(texts):
    with open(tz.VOCABULARY, "rb") as f:
        pass
    got = encode(texts)
    v = tz.load()
    assert [v.decode(np.array(x, np.int64)).decode() for x in got] == texts
    assert got == [ts._tokenizer(tz.VOCABULARY).encode_ordinary(t) for t in texts]


def merged(piece, rank):
    """Byte pairs merged in order of rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((rank[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in rank), default=None)
        if best is None:
            return [rank[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_backtracking_equals_merging():
    v = tz.load()
    rng = random.Random(4)
    for _ in range(1500):
        piece = bytes(rng.choice(b"abcdehilnorst '") for _ in range(rng.randrange(1, 30)))
        assert v.encode(piece) == merged(piece, v.rank), piece


def test_frame_and_cases(spark, make, truth):
    docs = [(i, s) for i, s in enumerate(SAMPLES)] + [(90, None), (None, "x"), (91, "long text " * 30_000), (1, " ")]
    df = tz.encode(make(docs))
    rows = df.collect()
    assert all(r.round_trip in (True, None) for r in rows) and len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[90].token_ids is None and by[90].n_tokens is None and by[0].token_ids == []
    assert by[91].token_ids == truth.encode_ordinary("long text " * 30_000) and by[None].n_tokens == 1
    back = {r.doc_id: r.text for r in tz.decode(df).collect()}
    assert back == dict(docs)
    assert tz.encode(make([])).count() == 0
    with pytest.raises(ValueError):
        tz.load().decode(np.array([10**6]))
    with pytest.raises(FileNotFoundError):
        tz.load("/nowhere")


def test_store_round_trip(spark, truth):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.repartition(4, "doc_id")
    stored = ts.store(spark, docs).cache()
    want = {r.doc_id: truth.encode_ordinary(r.text) for r in docs.collect()}
    assert {r.doc_id: r.token_ids for r in ts.read(stored).collect()} == want
    one = spark.createDataFrame([(5,), (17,)], "doc_id long")
    assert {r.doc_id: r.token_ids for r in ts.read(stored, one).collect()} == {k: want[k] for k in (5, 17)}
    head = stored.where("kind = 'dictionary'").first()
    assert head.dictionary_hash == ts.dictionary_hash(bytes(head.frame))
    rows = stored.where("kind = 'document'").collect()
    assert {r.dictionary_hash for r in rows} == {head.dictionary_hash}
    files = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.offset)):
        flat = files.setdefault(r.shard, bytearray())
        assert len(flat) == r.offset
        flat += r.frame
    assert len(files) > 1
    r = rows[3]
    raw = bytes(files[r.shard][r.offset : r.offset + r.length])
    assert ts.deserialise(ts.decompress(raw, bytes(head.frame))).tolist() == want[r.doc_id]


def test_dictionary_helps_short_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where(F.length("text") < 600)
    stored = ts.store(spark, docs)
    plain = ts.store(spark, docs, dictionary=b"")
    total = lambda d: d.where("kind = 'document'").agg(F.sum("length")).first()[0]
    assert total(stored) < 0.8 * total(plain)


def test_store_cases(spark, make):
    docs = make([(1, "some words"), (1, "some words"), (2, None), (3, ""), (None, "null id")])
    got = ts.store(spark, docs)
    rows = {}
    for r in got.where("kind = 'document'").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[1]) == 2 and rows[2][0].frame is None and rows[2][0].length == 0 and rows[3][0].n_tokens == 0 and len(rows[None]) == 1
    back = {r.doc_id: r.token_ids for r in ts.read(got).collect()}
    assert back[2] is None and back[3] == []
    empty = ts.store(spark, make([])).collect()
    assert [r.kind for r in empty] == ["dictionary"]
    other = got.withColumn("dictionary_hash", F.when(F.col("kind") == "document", "x").otherwise(F.col("dictionary_hash")))
    with pytest.raises(Exception, match="another dictionary"):
        ts.read(other).collect()
    broken = got.withColumn("dictionary_hash", F.lit("x"))
    with pytest.raises(ValueError):
        ts.read(broken)


def test_flat_files_are_read_by_range(spark, make, truth, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(4, "doc_id")
    more = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "twice"), (10**6 + 2, "twice"), (None, "no id"), (10**6 + 3, "long text " * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(more)
    folder = str(tmp_path / "tokens")
    index = ts.write(spark, docs, folder)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(None if r.text is None else truth.encode_ordinary(r.text))
    assert index.count() == docs.count()
    asked = spark.createDataFrame([(i,) for i in want if i is not None and (i % 3 == 0 or i >= 10**6)] + [(-7,), (None,)], "doc_id long")
    got = {}
    for r in ts.lookup(spark, folder, asked).collect():
        got.setdefault(r.doc_id, []).append(r.token_ids)
    assert got == {i: v for i, v in want.items() if i is not None and (i % 3 == 0 or i >= 10**6)}
    assert [x.tolist() for x in ts.fetch(spark, folder, 17)] == want[17] and ts.fetch(spark, folder, 10**6) == [None] and ts.fetch(spark, folder, -7) == []
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file, []).append(r)
    for name, rows in by_file.items():
        place = 0
        for r in sorted(rows, key=lambda r: (r.offset, r.length)):
            assert r.offset == place
            place += r.length
        assert (tmp_path / "tokens" / "shards" / name).stat().st_size == place
    assert ts.write(spark, make([]), str(tmp_path / "none")).count() == 0
    assert ts.lookup(spark, str(tmp_path / "none"), asked).count() == 0
    (tmp_path / "tokens" / "dictionary").write_bytes(b"x")
    with pytest.raises(ValueError):
        ts.fetch(spark, folder, 17)


def test_dictionary_is_trained_on_all_levels(spark):
    """Blocks of 20 kB make several levels; phrases of the last documents reach the dictionary too."""
    rare = "zirconium lattice baffles the heron quartet"
    rows = [(i, f"{rare} {i}" if i >= 2700 else f"plain words number {i % 89} and {i % 97} go here") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id")
    ws = ts.Workspace(spark, "levels")
    ids = ws.table(ts._ids(docs, ts.VOCABULARY), "ids")
    made = ts.train_dictionary(ws, ids, size=1 << 13, block=20_000)
    assert ts.serialise(" lattice baffles the heron") in made
    total = lambda d: sum(len(ts.compress(ts.serialise(t), d)) for _, t in rows)
    assert total(made) < total(b"")
    assert ts.train([b"abc"], 1 << 12) == b""
