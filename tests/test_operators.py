"""Joins and aggregates against brute force over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import signals
from corpusloom.operators import dedup, records, screen, stats
from corpusloom.plans import catalog
from corpusloom.workspace import Tables, numbered


def family_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w)))
    return [*out, (n, ""), (n + 1, "  "), (n + 2, None), (n + 3, out[0][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(family_texts(), "doc_id long, text string")


def test_numbered(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "x double, i int")
    got = {r.i: r.ordinal for r in numbered(Tables(spark, "n"), df, ["x"], "t").collect()}
    want = {r.i: k for k, r in enumerate(sorted(df.collect(), key=lambda r: r.x))}
    assert got == want
    assert numbered(Tables(spark, "n"), df.where("x > 2"), ["x"], "t").count() == 0


def test_simhash_window(spark, docs):
    rows = [(i, signals.simhash(t)) for i, t in family_texts() if t is not None]
    for window in (5, 128):
        want = {}
        for k, (i, h) in enumerate(rows):
            best = None
            for o, g in rows[max(0, k - window) : k]:
                d = bin((h ^ g) % (1 << 64)).count("1")
                shares = any((h >> s) & 0xFFFF == (g >> s) & 0xFFFF for s in (0, 16, 32, 48))
                if shares and d <= 4 and (best is None or d < best[0]):
                    best = (d, o)
            if best:
                want[i] = best
        sk = spark.createDataFrame(rows, "doc_id long, simhash long")
        got = {r.doc_id: (r.hamdist, r.simhash_dup_of) for r in dedup.simhash_window(spark, sk, window=window).collect()}
        assert got == want


def test_lsh(spark, docs):
    rows = [(i, signals.minhash(signals.shingle_hashes(t))) for i, t in family_texts() if t is not None]
    want = {}
    for k, (i, s) in enumerate(rows):
        mine, best = signals.band_keys(s), None
        for o, r in rows[:k]:
            if (mine == signals.band_keys(r)).any():
                j = float((s == r).sum() / 128)
                if best is None or j > best[0]:
                    best = (j, o)
        if best:
            want[i] = best
    got = {r.doc_id: (r.minhash_jaccard, r.minhash_of) for r in dedup.lsh_duplicates(spark, dedup.sketches(docs, sim=False)).collect()}
    assert got == want


def test_same_for_any_partitions(spark, docs):
    def run(n):
        sk = dedup.sketches(docs.repartition(n))
        return sorted(map(tuple, dedup.families(docs, dedup.simhash_window(spark, sk), dedup.lsh_duplicates(spark, sk)).collect()))

    assert run(1) == run(5)


def test_exact(spark, docs):
    got = {r.doc_id: (r.dup_of, r.copies) for r in dedup.exact_duplicates(docs).collect()}
    texts = dict(family_texts())
    for i, t in texts.items():
        if t is not None:
            same = [o for o, x in texts.items() if x == t]
            assert got[i] == (min(same) if min(same) != i else None, len(same))
    assert dedup.drop_exact(docs).count() == len({t for t in texts.values() if t is not None}) + 1


def test_store(spark, docs, tmp_path):
    sk = dedup.sketches(docs, sim=False)
    store = dedup.Store(spark, str(tmp_path / "s"))
    n = store.add(sk.where("doc_id < 30"))
    assert 0 < n <= 30
    assert store.add(sk.where("doc_id < 30")) == 0
    hits = {r.doc_id: r for r in store.check(sk).collect()}
    assert hits["63"].global_dup and hits["63"].score == 1.0
    assert store.duplicates_in_store().count() == 0
    with pytest.raises(ValueError):
        dedup.Store(spark, str(tmp_path / "s"), threshold=0.5)
    with pytest.raises(PermissionError):
        dedup.Store(spark, str(tmp_path / "s"), read_only=True).add(sk)
    with pytest.raises(FileNotFoundError):
        dedup.Store(spark, str(tmp_path / "none"), read_only=True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    sk = dedup.sketches(none)
    assert dedup.simhash_window(spark, sk).count() == 0
    assert dedup.lsh_duplicates(spark, sk).count() == 0
    assert dedup.exact_duplicates(none).count() == 0
    assert screen.quality(none).count() == 0


def test_penalty_and_decisions(spark):
    text = "Some words are here and the rest of it is a text of words. " * 5
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in screen.quality_decision(screen.with_duplicates(spark, screen.quality(df))).collect()}
    assert rows[2].dup_family_id == 1 and rows[2].near_dup and not rows[1].near_dup
    assert rows[2].score == pytest.approx(rows[1].score * 0.8 * 0.6)
    assert rows[2].qc_reason in ("low_score", "near_dup")


def test_gate_modes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, w boolean")
    assert screen.gate(df, "w", "inline").count() == 2
    assert screen.gate(df, "w", "post").count() == 3
    counts = screen.screener_counts(df, "w", mode="post").first()
    assert (counts.scored, counts.kept, counts.dropped, counts.would_drop) == (3, 3, 0, 1)
    with pytest.raises(ValueError):
        screen.gate(df, "w", "nope")


def test_pooled_stats(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    whole = stats.signal_stats(df, ["v"]).first()
    parts = stats.moments(stats.signal_stats(df.where("v < 10"), ["v"])).union(stats.moments(stats.signal_stats(df.where("v >= 10"), ["v"])))
    got = stats.pooled(parts).first()
    assert got.asDict() == pytest.approx(whole.asDict())


def test_merge_runs(spark):
    df = spark.createDataFrame([(1, 5, {"a": 1, "b": 2}, "x"), (2, None, {"b": 3}, "x")], "files long, records long, by_ext map<string,long>, c string")
    got = stats.merge_runs(df, "c").first()
    assert (got.files, got.records, got.by_ext) == (3, 5, {"a": 1, "b": 5})
    with pytest.raises(ValueError):
        stats.merge_runs(df.withColumn("c", F.col("files").cast("string")), "c")


@pytest.mark.parametrize(("n", "k"), [(10, 3), (3, 7), (0, 2), (14, 7)])
def test_shards(spark, n, k):
    got = [r.s for r in spark.range(n).select(stats.shard_of(F.col("id"), F.lit(n), k).alias("s")).collect()]
    base, extra = divmod(n, k)
    assert got == [i + 1 for i in range(k) for _ in range(base + (i < extra))]


def test_records(spark):
    df = spark.createDataFrame([("a/b.py", "x = 1\n", "cp1252"), ("r.md", "Plain words here", None), ("e.md", "", None)], "path string, text string, encoding string")
    rows = {r.meta.path: r.meta for r in records.tag_languages(records.from_files(df)).collect()}
    assert set(rows) == {"a/b.py", "r.md"}
    m = rows["a/b.py"]
    assert (m.kind, m.lang, m.decoding_fallback_used, m.nlines, m.bytes, m.chunk_id, m.n_chunks) == ("code", "Python", True, 2, 6, 1, 1)
    assert rows["r.md"].language == "en" and rows["r.md"].lang == "Markdown"


def test_top_families(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)] + [(20, 99)], "doc_id long, dup_family_id long")
    got = [(r.dup_family_id, r["count"], r.examples) for r in dedup.top_families(df, top=2).collect()]
    assert got == [(0, 4, [0, 3, 6]), (1, 3, [1, 4, 7])]


def test_minhash_signature_equals_brute_force(spark, tmp_path):
    texts = {1: "the quick brown fox jumps over the lazy dog " * 3, 2: "", 3: None, 4: "short", 5: "Ünïcode words, and more of them"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [r[f"m{i}"] for i in range(128)] for r in catalog.QUERIES["minhash_signature"](spark, str(tmp_path)).collect()}
    assert got.pop(3) == [None] * 128  # a null text has no signature
    for i in got:
        h = [int(x) for x in signals.shingle_hashes(texts[i])]
        assert got[i] == [min(((int(a) * x + int(b)) % signals.PRIME for x in h), default=signals.PRIME) for a, b in signals.coefficients(128)]


def test_a_batch_run_again_is_written_again(spark, tmp_path):
    """A batch that failed after its signatures were stored comes back whole."""
    from corpusloom.streaming import ingest

    store = dedup.Store(spark, str(tmp_path / "s"))
    base = "some words of a long text that two rows of one batch share but for the end " * 4
    first = spark.createDataFrame([("a", base + "one", None), ("b", base + "one", None), ("c", base + "two", None), ("d", "something else altogether " * 9, None)], ingest.SCHEMA)
    written = lambda n: sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect())
    ingest.store_batch(first, store, f"{tmp_path}/out", 0, "q#0")
    assert written(0) == ["a", "c", "d"]
    ingest.store_batch(first, store, f"{tmp_path}/out", 0, "q#0")
    assert written(0) == ["a", "c", "d"] and store.signatures().count() == 3
    later = spark.createDataFrame([("e", base + "one", None), ("f", "new words only here " * 9, None)], ingest.SCHEMA)
    for _ in range(2):
        ingest.store_batch(later, store, f"{tmp_path}/out", 1, "q#1")
        assert written(1) == ["f"]
    again = {r.doc_id: r.match_id for r in store.check(dedup.sketches(first, sim=False)).collect()}
    assert again["d"] is None and again["a"] == "c" and again["b"] == "a"


def test_whole_texts_count_unless_a_bound_is_set(spark):
    """Texts that differ only beyond the old bounds have signatures of their own."""
    head = " ".join(f"head{i}" for i in range(30_000))
    rows = [(1, head + " tail of one kind"), (2, head + " quite another ending"), (3, head[:330_000] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in dedup.sketches(df).collect()}
    assert whole[1].minhash != whole[2].minhash
    capped = {r.doc_id: r for r in dedup.sketches(df, max_tokens=20_000, max_shingles=20_000).collect()}
    assert capped[1].minhash == capped[2].minhash and capped[1].simhash == capped[2].simhash
    rep = lambda n: {r.doc_id: r.s.repeats for r in df.select("doc_id", signals.text_signals(sim=False, min_hash=False, max_grams=n)(df.text).alias("s")).collect()}[3]
    brute = len(rows[2][1]) - 15 - len({rows[2][1][i : i + 16] for i in range(len(rows[2][1]) - 15)})
    assert rep(None) == brute > 200_000 and rep(20_000) == 0
    assert screen.quality(df).where("parse_ok = 1").count() == 3


def test_lsh_hot_buckets(spark):
    """A band that all rows share, copies and values above 32 bits: the same as brute force in lists, tiles and split buckets, and no pairs are joined."""
    import numpy as np

    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 3, (300, 128)) + 10 * np.arange(128)
    sigs[:, :4] = 7
    sigs[250:] = rng.integers(0, 1 << 32, (50, 128))  # no band with the rest
    sigs[260:270], sigs[280], sigs[:20, 5] = signals.PRIME, sigs[3], signals.PRIME
    want = {}
    keys = [signals.band_keys(x) for x in sigs]
    for i in range(300):
        best = max(((int((sigs[i] == sigs[j]).sum()), -j) for j in range(i) if (keys[i] == keys[j]).any()), default=None)
        if best:
            want[i] = (best[0] / 128, -best[1])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sigs)], "doc_id long, minhash array<bigint>")
    for most in (16384, 60):
        out = dedup.lsh_duplicates(spark, df, most=most)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: (r.minhash_jaccard, r.minhash_of) for r in out.collect()} == want
    named = dedup.lsh_duplicates(spark, df.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    assert {int(r.doc_id): (r.minhash_jaccard, int(r.minhash_of)) for r in named.collect()} == want
