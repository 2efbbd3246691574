"""The whole pipeline against its stages by brute force, and every registered query's schema."""

import pytest
from comparing import assert_equal
from test_near import brute as near_brute
from test_packing import check
from test_substring import brute as span_brute

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import near_dedup, queries, quality, substring_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = near_dedup.Workspace(spark, "stages").table(stage(spark, docs, sf), str(k))
        if k < 3:
            assert docs.dtypes == before.dtypes
        rows.append((before, docs))
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    # 1: decisions of the field
    m = quality.fit(rows[0][0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(rows[0][1]) == {r.doc_id for r in quality.label_lines(rows[0][0], m).where("keep").collect()}
    # 2: one of each group
    texts = {r.doc_id: r.text for r in rows[1][0].collect()}
    groups = near_brute(list(texts.items()), near_dedup.THRESHOLD)
    want = {i for i in texts if groups.get(i, (i, 1))[0] == i}
    got = ids(rows[1][1])
    assert len(got ^ want) <= 0.1 * max(1, len(texts) - len(want))
    # 3: repeated passages
    texts = {r.doc_id: r.text for r in rows[2][0].collect()}
    marks = span_brute(list(texts.items()), substring_dedup.MIN_WORDS)
    after = {r.doc_id: r.text for r in rows[2][1].collect()}
    assert set(after) == set(texts)
    cut = sum(len(texts[i].split()) - len(after[i].split()) for i in texts)
    assert cut >= 0.9 * sum(map(len, marks.values()))
    for i, t in texts.items():
        words = t.split()
        assert len(after[i].split()) >= len(words) - len(marks[i])
        assert marks[i] or after[i] == t
    # 4: every token of the rest in a window
    check(rows[3][1].collect(), {i: (len(t) + 3) // 4 for i, t in after.items() if t}, 2048)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {tuple(r) for r in rows[3][1].collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert_equal(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def write_tables(spark, folder, docs, labels):
    wide = [(*d, "x", 1, "y", None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(wide, "doc_id long, text string, owner string, lead long, shard string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_defined_cases_of_all_stages(spark, tmp_path):
    """Nulls, empty and blank texts, repeated rows and ids, copies, a very long text, clashing column names."""
    import random

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)).capitalize() + "."
    junk = lambda: "!!! ".join(rng.choice(["HOME", "CLICK", "$$$", "###"]) for _ in range(9)) + "!!!"
    docs = [(i, prose(60)) for i in range(20)] + [(100 + i, junk()) for i in range(12)]
    labels = [(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(12)]
    shared = prose(70)
    docs += [(200, None), (201, ""), (202, " \n "), (None, prose(60)), (203, docs[3][1]), (204, prose(60)), (205, shared + " " + prose(150)), (206, prose(150) + " " + shared), (207, prose(40_000)), (5, prose(60))]
    docs += [docs[4], docs[4]]
    write_tables(spark, tmp_path, docs, labels)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert set(got) == {*range(20), None, 204, 205, 206, 207}, "junk, blank texts, and the copy 203 of 3 go"
    size = {}
    for i, t in docs:
        if i != 206 and t:
            size.setdefault(i, set()).add(t)
    for i in got:
        if i != 206:
            assert got[i] == sum((len(t) + 3) // 4 for t in size[i])
    assert got[206] == (len(docs[-6][1]) - len(shared) + 3) // 4, "the passage of 205 is cut from 206"


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "window_id" in out.columns
