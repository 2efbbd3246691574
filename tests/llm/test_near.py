import random

import numpy as np
import pytest

from corpusloom.llm import near_dedup as nd
from corpusloom.llm import textkit as tk


def sketch(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return nd.sketch(np.frombuffer(b"".join(raw), np.uint8), off)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmn") for _ in range(6)) for _ in range(n)]


def test_merge_is_the_union():
    """Sketches of parts merge to the sketch of all parts' 3-grams."""
    rng = random.Random(1)
    a, b = words(rng, 300), words(rng, 200)
    ra, rb = (sketch([" ".join(x)])[1][0] for x in (a, b))
    g = np.concatenate([tk.shingles(np.frombuffer(" ".join(x).encode(), np.uint8), np.array([0, len(" ".join(x))]), 3)[0] for x in (a, b)])
    least = np.array([((g ^ x) * m).min() for x, m in zip(nd._XOR, nd._MUL, strict=True)])
    assert np.array_equal(nd.merge(ra, rb), nd._register(least))


def test_cardinality_and_estimate():
    rng = random.Random(2)
    errors = []
    for share in (0.2, 0.5, 0.7, 0.9):
        n = 2000
        a = words(rng, n)
        b = a[: int(n * share)] + words(rng, n - int(n * share))
        _, regs = sketch([" ".join(a), " ".join(b)])
        assert abs(nd.cardinality(regs[:1])[0] / (n - 2) - 1) < 0.3
        truth = nd.jaccard(nd.shingle_set(" ".join(a)), nd.shingle_set(" ".join(b)))
        errors.append(abs(nd.estimate(regs[:1], regs[1:])[0] - truth))
    assert max(errors) < 0.15


def corpus(seed, n=80):
    rng = random.Random(seed)
    out = []
    for _ in range(n // 4):
        base = words(rng, rng.randrange(30, 120))
        for k in range(4):
            w = list(base)
            for _ in range(int(len(w) * (0, 0.03, 0.08, 0.5)[k])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def brute(docs, threshold):
    sets = {i: nd.shingle_set(t) for i, t in docs if t is not None}
    texts = dict(docs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if texts[a] == texts[b] or nd.jaccard(sets[a], sets[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: (r, len(m)) for r, m in groups.items() if len(m) > 1 for i in m}


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_brute_force(spark, make, seed):
    docs = corpus(seed)
    want = brute(docs, nd.THRESHOLD)
    got = {r.doc_id: (r.group_id, r.group_size) for r in nd.near_groups(spark, make(docs)).collect()}
    pairs = lambda g: {(i, r) for i, (r, _) in g.items() if i != r}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    assert set(got) <= set(want), "verified: no document without a partner"


def test_large_group_and_chain(spark, make):
    rng = random.Random(5)
    base = words(rng, 60)
    docs = [(i, " ".join(base)) for i in range(300)]
    chain, w = [], words(rng, 100)
    for i in range(12):
        chain.append((1000 + i, " ".join(w)))
        w = w[4:] + words(rng, 4)
    got = {r.doc_id: (r.group_id, r.group_size) for r in nd.near_groups(spark, make(docs + chain)).collect()}
    assert all(got[i] == (0, 300) for i in range(300))
    assert all(got[1000 + i] == (1000, 12) for i in range(12))


def test_defined_cases(spark, make):
    rng = random.Random(6)
    t = " ".join(words(rng, 40))
    docs = make([(None, t), (1, t), (2, t), (3, None), (4, ""), (5, ""), (6, "!!!"), (7, "one"), (8, "one"), (9, "ONE!"), (2, t), (10, t), (10, "quite another text of words")])
    got = {r.doc_id: (r.group_id, r.group_size) for r in nd.near_groups(spark, docs).collect()}
    assert got[1] == got[2] == got[10] == (1, 3)
    assert got[4] == got[5] == (4, 2) and got[7] == got[8] == got[9] == (7, 3)
    assert not {3, 6, None} & set(got)
    kept = nd.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
    assert nd.near_groups(spark, make([])).count() == 0
    assert nd.drop_near_duplicates(spark, make([(1, t), (1, t)])).count() == 1


def test_long_text(spark, make):
    rng = random.Random(7)
    w = words(rng, 80_000)
    got = {r.doc_id: r.group_id for r in nd.near_groups(spark, make([(1, " ".join(w)), (2, " ".join(w[:-50])), (3, " ".join(words(rng, 500)))])).collect()}
    assert got == {1: 1, 2: 1}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.doc_id: r.root for r in nd.components(nd.Workspace(spark, "c"), "t", df).collect()}
    assert got == want
