import random

import pytest

from corpusloom.llm import packing


def naive(sizes, window):
    """Sum of squares by trying every level."""
    out, fill, order, made, tick = [], {}, {}, 0, 0
    for i, size in enumerate(sizes):
        part = 0
        while size >= window:
            out.append((i, part, made, 0, window))
            made, part, size = made + 1, part + 1, size - window
        if size <= 0:
            continue
        counts = [0] * (window + 1)
        for h in fill.values():
            counts[h] += 1
        best = None
        for h in range(window - size, -1, -1):
            if h and not counts[h]:
                continue
            after = counts[:]
            if h:
                after[h] -= 1
            if h + size < window:
                after[h + size] += 1
            total = sum(c * c for c in after[1:window])
            if best is None or total < best[0]:
                best = (total, h)
        h = best[1]
        if h:
            w = min((w for w, f in fill.items() if f == h), key=order.__getitem__)
        else:
            w, made = made, made + 1
        out.append((i, part, w, h, size))
        fill.pop(w, None)
        if h + size < window:
            fill[w], order[w], tick = h + size, tick, tick + 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_equals_naive(seed):
    rng = random.Random(seed)
    window = rng.choice([5, 12, 30])
    sizes = [rng.randrange(0, window * 2 + 2) for _ in range(150)]
    assert packing.pack_sizes(sizes, window) == naive(sizes, window)


def check(rows, sizes, window):
    """Every token once, no overlap within a window."""
    held, parts = {}, {}
    for r in rows:
        assert 0 <= r.offset and r.offset + r.n_tokens <= window
        for t in range(r.offset, r.offset + r.n_tokens):
            assert (r.shard, r.window_id, t) not in held
            held[r.shard, r.window_id, t] = 1
        parts[r.doc_id] = parts.get(r.doc_id, 0) + r.n_tokens
    assert parts == sizes


def test_frame(spark, make):
    rng = random.Random(2)
    docs = [(i, "x" * rng.randrange(0, 400)) for i in range(200)] + [(300, None), (301, "y" * 3000)]
    rows = packing.pack(make(docs), window=64, shard_docs=50).collect()
    check(rows, {i: (len(t) + 3) // 4 for i, t in docs if t}, 64)
    assert len({r.shard for r in rows}) == 5


def test_shards_equal_naive(spark, make):
    docs = [(i, "x" * (37 * i % 251 + 1)) for i in range(120)]
    rows = packing.pack(make(docs), window=50, shard_docs=40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for shard in by.values():
        ids = sorted({r.doc_id for r in shard})
        want = naive([(len(docs[i][1]) + 3) // 4 for i in ids], 50)
        assert sorted((r.doc_id, r.part, r.window_id, r.offset, r.n_tokens) for r in shard) == sorted((ids[i], p, w, o, n) for i, p, w, o, n in want)


def test_defined_cases(spark, make):
    assert packing.pack(make([])).count() == 0
    rows = packing.pack(make([(1, None), (2, ""), (None, "abcd"), (3, "abcd"), (3, "abcd"), (3, "abcdefgh")])).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 1), (3, 1), (3, 1), (3, 2)]
    own = spark.createDataFrame([(1, 7), (2, None), (3, 0), (4, -2)], "doc_id long, k int")
    assert [(r.doc_id, r.n_tokens) for r in packing.pack(own, 10, "k").collect()] == [(1, 7)]
