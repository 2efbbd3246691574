import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import crf, quality


def model(seed, f=3):
    r = np.random.default_rng(seed)
    return crf.Model(tuple(r.normal(size=f)), tuple(r.normal(size=4)), float(r.normal()))


def score(y, e, m):
    s = (e[0] + m.start) * y[0]
    for k in range(1, len(y)):
        s += m.t[2 * y[k - 1] + y[k]] + e[k] * y[k]
    return s


def test_viterbi_equals_enumeration():
    for seed in range(30):
        m, r = model(seed), np.random.default_rng(seed + 100)
        e = r.normal(size=r.integers(1, 8)).tolist()
        best = max(score(y, e, m) for y in itertools.product((0, 1), repeat=len(e)))
        assert score(crf.viterbi(e, m), e, m) == pytest.approx(best)
    assert crf.viterbi([], m) == []
    assert crf.viterbi([0.0, 0.0], crf.Model((0.0,), (0.0,) * 4, 0.0)) == [1, 1]  # ties: content


def test_gradient_and_likelihood():
    r = np.random.default_rng(4)
    seqs = [(r.normal(size=(n, 3)), r.integers(0, 2, n)) for n in (5, 3, 1)]
    lengths = np.array([5, 3, 1])
    x, y = np.zeros((3, 5, 3)), np.zeros((3, 5), int)
    for i, (a, b) in enumerate(seqs):
        x[i, : len(b)], y[i, : len(b)] = a, b
    theta = r.normal(size=8)
    value, grad = crf._objective(theta, x, y, lengths, 0.5)
    m = crf.Model(tuple(theta[:3]), tuple(theta[3:7]), theta[7])
    want = 0.25 * theta @ theta
    for a, b in seqs:
        e = (a @ theta[:3]).tolist()
        want += np.log(sum(np.exp(score(p, e, m)) for p in itertools.product((0, 1), repeat=len(e)))) - score(b, e, m)
    assert value == pytest.approx(want)
    for k in range(8):
        d = np.zeros(8)
        d[k] = 1e-6
        slope = (crf._objective(theta + d, x, y, lengths, 0.5)[0] - crf._objective(theta - d, x, y, lengths, 0.5)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-4)


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "evening", "letters", "carry", "quiet"]) for _ in range(12)).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(["HOME", "LOGIN", "###", "CLICK!!!", "$$$"]) for _ in range(5))
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        docs.append((i, "\n".join((prose if good else junk)() for _ in range(rng.randrange(2, 7)))))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, make):
    docs, labels = corpus()
    rated = spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int")
    df = make(docs)
    m = quality.fit(df, rated)
    got = {r.doc_id: r.keep for r in quality.label_lines(df, m).collect()}
    hits = sum(got[i] == bool(q) for i, q, _ in labels[60:])
    assert hits >= 0.95 * len(labels[60:])
    kept = quality.quality_filter(df, m)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_accuracy_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.keep for r in quality.label_lines(docs, m).collect()}
    rows = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([got[r.doc_id] == bool(r.quality) for r in rows]) >= 0.9


def mixed(n, seed):
    """Documents of prose and junk lines in turn, rated by which have more words, and the truth of every line."""
    rng = random.Random(seed)
    docs, labels, truth = [], [], []
    for i in range(n):
        q, lines = i % 2, []
        while not lines or (sum(len(t.split()) for t, c in lines if c) >= 0.5 * sum(len(t.split()) for t, _ in lines)) != bool(q):
            runs = [(rng.random() < (0.75 if q else 0.25), rng.randrange(2, 6)) for _ in range(rng.randrange(2, 6))]
            lines = [(line(rng, c), c) for c, k in runs for _ in range(k)]
        docs.append((i, "\n".join(t for t, _ in lines)))
        labels.append((i, q, 0))
        truth.append([int(c) for _, c in lines])
    return docs, labels, truth


def line(rng, good):
    if good:
        return " ".join(rng.choice(["river", "stone", "walks", "under", "evening", "letters", "carry", "quiet"]) for _ in range(rng.randrange(6, 14))).capitalize() + "."
    return rng.choice([" | ", " "]).join(rng.choice(["HOME", "LOGIN", "###", "CLICK!!!", "$$$", "Next", "more"]) for _ in range(rng.randrange(4, 9)))


def test_labels_lines_of_mixed_documents(spark, make):
    import pyarrow as pa

    docs, labels, truth = mixed(160, 5)
    m = quality.fit(make(docs), spark.createDataFrame(labels[:80], "doc_id long, quality int, toxic int"))
    data, off = quality.tk.utf8(pa.array([t for _, t in docs[80:]]))
    row, _, y = quality.decode(data, off, m)
    want = [v for t in truth[80:] for v in t]
    assert len(y) == len(want) and np.mean(y == want) >= 0.95
    got = {r.doc_id: r for r in quality.label_lines(make(docs[80:]), m).collect()}
    assert np.mean([(0 < got[80 + k].content_share < 1) == (0 < sum(t) < len(t)) for k, t in enumerate(truth[80:])]) >= 0.95
    assert np.mean([0 < r.content_share < 1 for r in got.values()]) >= 0.5
    assert np.mean([got[i].keep == bool(q) for i, q, _ in labels[80:]]) >= 0.95


def test_counts_equal_a_plain_decoding(spark, make):
    """Line by line: features of a line alone in its text but for the echo, Viterbi by enumeration of short texts."""
    docs, labels, _ = mixed(60, 6)
    docs = [(i, "\n".join(t.split("\n")[:9])) for i, t in docs] + [(60, "Same here.\n\n \nSame here.\r\nOther one")]
    m = quality.fit(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.label_lines(make(docs), m).collect()}
    for i, t in docs:
        lines = [x for x in t.replace("\r", "\n").split("\n") if x.split()]
        xs = []
        for k, x in enumerate(lines):
            b = np.frombuffer(x.encode(), np.uint8)
            f = quality.line_features(b, np.array([0, len(b)]))[2][0].astype(float)
            f[7] = any(lines[j].split() == x.split() for j in (k - 1, k + 1) if 0 <= j < len(lines))
            xs.append(f)
        e = (np.array(xs) @ np.array(m.w)).tolist()
        best = max(itertools.product((0, 1), repeat=len(e)), key=lambda y: score(y, e, m))
        words = [len(x.split()) for x in lines]
        share = sum(n * v for n, v in zip(words, best, strict=True)) / sum(words)
        assert (got[i].n_lines, got[i].n_content_lines, got[i].keep) == (len(lines), sum(best), share >= 0.5)
        assert got[i].content_share == pytest.approx(share)


def test_a_share_equal_to_the_least_is_enough(spark, make):
    m = crf.Model(tuple(1.0 if k == 11 else 0.0 for k in range(quality.FEATURES)), (0.0,) * 4, 0.0)  # content ends in a stop mark; -0.5 else
    m = crf.Model((-0.5, *m.w[1:]), m.t, m.start)
    rows = [(1, "one two.\nthree four"), (1, "one two.\nthree four"), (2, "one two.\nthree four five")]
    assert sorted((r.doc_id, r.content_share, r.keep) for r in quality.label_lines(make(rows), m).collect()) == [(1, 0.5, True), (1, 0.5, True), (2, 0.4, False)]


def test_defined_cases(spark, make):
    docs, labels = corpus(30)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = quality.fit(make(docs), rated)
    odd = [(1, None), (2, ""), (3, " \n\r\n "), (None, docs[1][1]), (5, docs[1][1]), (5, docs[1][1]), (6, docs[1][1] * 3000)]
    got = {}
    for r in quality.label_lines(make(odd), m).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(not got[i][0].keep and got[i][0].content_share == 0 for i in (1, 2, 3))
    assert got[None][0].keep and got[6][0].keep and len(got[5]) == 2
    assert quality.quality_filter(make(odd), m).count() == 4
    none = quality.fit(make(docs), rated.where("doc_id < 0"))
    assert not none.trained and quality.quality_filter(make(odd), none).count() == 4
    one = quality.fit(make(docs), rated.where("quality = 1"))
    assert not one.trained
    assert quality.label_lines(make([]), m).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert not quality.fit(make(docs), nulls).trained


def test_same_for_any_batches():
    import pyarrow as pa

    docs, _ = corpus(40)
    m = crf.Model(tuple(np.random.default_rng(1).normal(size=quality.FEATURES)), (0.1, -0.2, 0.3, 0.0), 0.1)
    whole = quality.shares(pa.array([t for _, t in docs]), m)
    parts = [quality.shares(pa.array([t]), m) for _, t in docs]
    for a, b in zip(whole, map(np.concatenate, zip(*parts, strict=True)), strict=True):
        assert np.allclose(a, b)
