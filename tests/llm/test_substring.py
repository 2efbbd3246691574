import random

import pytest

from corpusloom.llm import substring_dedup as sd


def test_automaton_equals_brute_force():
    for seed in range(40):
        rng = random.Random(seed)
        refs = [[rng.choice("abc") for _ in range(rng.randrange(0, 15))] for _ in range(3)]
        q = [rng.choice("abc") for _ in range(25)]
        a = sd.SuffixAutomaton()
        for r in refs:
            a.add(r)
        have = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in have), default=0) for i in range(len(q))]
        assert list(a.statistics(q)) == want


def brute(docs, least):
    """doc -> set of word places inside a run of ``least`` words that an earlier document holds."""
    seen, out = {}, {}
    for i, t in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        w = t.split()
        marks = set()
        for k in range(len(w) - least + 1):
            g = tuple(w[k : k + least])
            if seen.setdefault(g, i) < i:
                marks.update(range(k, k + least))
        out[i] = marks
    return out


def planted(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passages = [[word() for _ in range(rng.randrange(8, 25))] for _ in range(5)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [word() for _ in range(rng.randrange(0, 12))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(0, 3)
                w += p[a:] if rng.random() < 0.5 else p
        docs.append((i, rng.choice([" ", "\n"]).join(w)))
    docs += [(n, docs[3][1]), (n + 1, docs[3][1])]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_finds_what_brute_force_finds(spark, make, seed):
    docs = planted(seed)
    want, got = brute(docs, 8), {}
    for r in sd.repeated_spans(spark, make(docs), 8, 5).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    assert got == {i: m for i, m in want.items() if m}


def covered(spans):
    got = {}
    for r in spans.collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    return got


@pytest.mark.parametrize("seed", range(3))
def test_finds_all_that_brute_force_finds(spark, make, seed):
    docs = planted(seed)
    assert covered(sd.repeated_spans(spark, make(docs), 8, 5)) == {i: m for i, m in brute(docs, 8).items() if m}


def truncated(rng, cases=30, length=55, piece=49, copies=5):
    """Passages that an earlier document holds only a piece of."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda: [word() for _ in range(rng.randrange(0, 30))]
    docs = []
    for _ in range(cases):
        p = [word() for _ in range(length)]
        a = rng.randrange(0, length - piece + 1)
        for part in [p[a : a + piece], *[p] * copies]:
            docs.append((len(docs), " ".join(fill() + part + fill())))
    return docs


def excerpts(rng, n=60):
    """Documents that each hold another excerpt of one long passage."""
    p = [f"{rng.randrange(10**6)}" for _ in range(400)]
    cut = lambda: (lambda a: p[a : a + rng.randrange(32, 120)])(rng.randrange(0, 380))
    return [(i, " ".join([f"h{i}", *cut(), f"m{i}", *cut()])) for i in range(n)]


@pytest.mark.parametrize("docs", [truncated(random.Random(1)), truncated(random.Random(2), length=60, piece=40), excerpts(random.Random(3))], ids=["first 49 of 55", "40 of 60", "excerpts"])
def test_holders_of_shorter_pieces(spark, make, docs):
    assert covered(sd.repeated_spans(spark, make(docs))) == {i: m for i, m in brute(docs, 50).items() if m}


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_join_equals_broadcast(spark, make, monkeypatch, limit):
    docs = planted(7)
    monkeypatch.setattr(sd, "BROADCAST_BYTES", limit)
    got = sorted((r.doc_id, r.text) for r in sd.remove_repeats(spark, make(docs), 8, 5).collect())
    monkeypatch.undo()
    assert got == sorted((r.doc_id, r.text) for r in sd.remove_repeats(spark, make(docs), 8, 5).collect())


def test_production_threshold(spark, make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, short = [word() for _ in range(60)], [word() for _ in range(49)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [(10, " ".join(fill(30) + shared + fill(30) + short)), (11, " ".join(fill(80) + shared + fill(9))), (12, " ".join(fill(20) + short)), (13, " ".join(shared)), (14, " ".join(fill(70)))]
    got = {r.doc_id: (r.text, r.gone) for r in sd.remove_repeats(spark, make(docs), count="gone").collect()}
    assert got[10] == (docs[0][1], 0) and got[12][1] == 0 and got[14][1] == 0
    assert got[11][1] == 60 and not any(w in got[11][0] for w in shared)
    assert got[13] == ("", 60)


def test_defined_cases(spark, make):
    t = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, t), (1, t), (2, None), (None, t), (3, ""), (4, t + " tail"), (5, "head " + t * 1), (6, t.replace(" ", "\n\t "))])
    out = sd.remove_repeats(spark, docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in got[1]] == [t, t] and got[None][0].text == t and got[2][0].text is None and got[3][0].text == ""
    assert (got[4][0].text, got[5][0].text, got[6][0].text) == ("tail", "head ", "")
    assert got[4][0].n_chars == 4 and got[2][0].n_chars is None
    assert sd.remove_repeats(spark, make([])).count() == 0
    with pytest.raises(ValueError):
        sd.repeated_spans(spark, docs, 10, 20)


def test_long_text(spark, make):
    rng = random.Random(3)
    big = " ".join(str(rng.randrange(10**6)) for _ in range(60_000))
    got = {r.doc_id: r.text for r in sd.remove_repeats(spark, make([(1, big), (2, "x " + big + " y")])).collect()}
    assert got == {1: big, 2: "x y"}


def test_repeated_ids_with_other_texts(spark, make):
    """A row is only cut by what its own text repeats."""
    p, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 80), ("x", 80), ("y", 200)))
    rows = [(1, " ".join(p)), (2, " ".join(p + x)), (2, " ".join(y)), (3, " ".join(y[:90])), (3, " ".join(x[5:]))]
    got = sorted((r.doc_id, r.text) for r in sd.remove_repeats(spark, make(rows)).collect())
    assert got == sorted([(1, rows[0][1]), (2, " ".join(x)), (2, rows[2][1]), (3, ""), (3, "")])


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_repeated_ids_equal_brute_force(spark, make, monkeypatch, limit):
    """Ids repeat in pairs; a row is compared with all rows of smaller ids.  Salts of two regions."""
    monkeypatch.setattr(sd, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(sd, "REGIONS", 2)
    docs = [(i // 2, t) for i, t in planted(11)]
    words = [(i, t.split()) for i, t in docs]
    least = {}
    for i, w in words:
        for k in range(len(w) - 7):
            g = tuple(w[k : k + 8])
            least[g] = min(least.get(g, i), i)
    want = {}
    for i, w in words:
        marks = {m for k in range(len(w) - 7) if least[tuple(w[k : k + 8])] < i for m in range(k, k + 8)}
        want.setdefault((i, " ".join(x for k, x in enumerate(w) if k not in marks)), []).append(1)
    got = {}
    for r in sd.remove_repeats(spark, make(docs), 8, 5).collect():
        got.setdefault((r.doc_id, " ".join(r.text.split())), []).append(1)
    assert got == want


def test_count_names_a_new_column(spark, make):
    with pytest.raises(ValueError):
        sd.remove_repeats(spark, make([(1, "a")]), count="Owner")
