import math
import re
from collections import Counter

from corpusloom.llm import licences as lc

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(t):
    return [w.lower() for w in WORD.findall(t)]


BREAK, BLANK = re.compile(r"\r\n|\n\r|\r|\n"), " \t\x0b\x0c\x1c\x1d\x1e\x1f"


def runs(lines, inside):
    out = [[]]
    for x in lines:
        if inside(x):
            out[-1].append(x)
        else:
            out.append([])
    return ["\n".join(x) for x in out if x]


def units(text, is_file):
    lines = BREAK.split(text or "")
    return [*lines, *runs(lines, terms), *runs(lines, lambda x: x.strip(BLANK)), *([text or ""] if is_file else [])]


def brute(rows, threshold=lc.THRESHOLD):
    """TF-IDF cosines and directories by loops."""
    texts = [t for _, t, _ in rows if t is not None]
    names = [n for n, ts in sorted(lc.TEMPLATES.items()) for _ in ts]
    templates = [Counter(terms(t)) for _, ts in sorted(lc.TEMPLATES.items()) for t in ts]
    df = Counter(w for t in texts for w in set(terms(t)))
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    norms = [math.sqrt(sum((c * idf(w)) ** 2 for w, c in t.items())) for t in templates]

    def cosines(a):
        na = math.sqrt(sum((c * idf(w)) ** 2 for w, c in a.items()))
        return [sum(c * idf(w) * t[w] * idf(w) for w, c in a.items() if w in t) / (na * nb) for t, nb in zip(templates, norms, strict=True)] if a else []

    def own(text, path):
        best = (0, 0.0, 0)
        for u in units(text, bool(path and path.rpartition("/")[2].lower() in lc.FILE_NAMES)):
            a = Counter(terms(u))
            top = max(((round(c, 9), -k) for k, c in enumerate(cosines(a))), default=(0, 0))
            if top[0] >= threshold:
                best = max(best, (round(sum(a.values()) * top[0], 6), *top))
        return (names[-best[2]], best[1]) if best[0] else (None, None)

    out, lends = [], {}
    for i, t, p in rows:
        path = None if p is None else re.sub("/+", "/", p).strip("/")
        lic, cos = own(t, path)
        out.append([i, path, lic, cos, "own" if lic else None, None])
        if lic and path and path.rpartition("/")[2].lower() in lc.FILE_NAMES:
            folder = path.rpartition("/")[0]
            lends[folder] = min(lends.get(folder, (9, "", "")), (-cos, path, lic))
    for r in out:
        if r[2] is None and r[1] is not None:
            folder = r[1].rpartition("/")[0]
            while True:
                if folder in lends:
                    c, p, lic = lends[folder]
                    r[2:] = [lic, -c, "inherited", p]
                    break
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
    return sorted(map(tuple, out), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, path string, folder string, licence string")
    got = [(r.doc_id, r.path, r.licence, None if r.cosine is None else round(r.cosine, 6), r.source, r.inherited_from) for r in lc.scan(df).collect()]
    return sorted(got, key=repr)


def rounded(rows):
    return sorted([(*r[:3], None if r[3] is None else round(r[3], 6), *r[4:]) for r in rows], key=repr)


TREE = [
    (1, "Released under the MIT License.", "LICENSE"),
    (2, "no notice in this text", "a/b/c.txt"),
    (3, "Licensed under the Apache License, Version 2.0", "a/LICENSE"),
    (4, "# SPDX-License-Identifier: ISC\ncode", "a/b/d.py"),
    (5, "x", "top.txt"),
    (6, None, "/a//b/"),
    (7, "", "a/e.txt"),
    (8, "text", None),
    (9, "Released under the MIT License.", "a/copying"),
    (9, "Released under the MIT License.", "a/copying"),
    (10, "This work is licensed under the GNU General Public License, version 3.\n" + "filler words " * 4000, "z/y/x/w.txt"),
    (11, "ab", "ax/e.txt"),
    (12, "words", "z/y/LICENSE"),
    (None, "released under the mit licence", "q/r"),
]


def test_equals_brute_force(spark):
    assert run(spark, TREE) == rounded(brute(TREE))


def test_equals_brute_force_without_root_licence(spark):
    rows = [r for r in TREE if r[0] != 1]
    assert run(spark, rows) == rounded(brute(rows))


def test_the_documents(spark):
    docs = lc.with_paths(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [(r.doc_id, r.text, r.path) for r in docs.collect()]
    assert run(spark, rows) == rounded(brute(rows))


def openings(name):
    """The first lines of a standard text, without what names its owner."""
    lines = [x for x in lc.TEXTS[name].splitlines() if "opyright (" not in x and "All rights" not in x]
    return "\n".join(lines[:9])


def wrapped(text, mark):
    return "\n".join(f"{mark} {x}".rstrip() for x in text.splitlines())


def test_standard_texts_are_found_as_themselves(spark):
    """Whole files, with an owner named, their openings, comment headers, and notices inside long prose: at two sizes of the corpus."""
    prose = "the cat sat on the mat of the house and it was free to go for all that it knew " * 40
    cases = []
    for n, t in sorted(lc.TEXTS.items()):
        cases += [(n, t, "LICENSE"), (n, t.replace("[year]", "2031").replace("[fullname]", "Mary Major"), "x/COPYING"), (n, wrapped(t, " *") + "\n" + prose, "a.c"), (n, wrapped(t, "#"), "a.py")]
        cases.append((n, openings(n), "LICENSE.txt") if n != "BSD-3-Clause" else (n, t, "LICENSE.txt"))
    for n, notices in lc.NOTICES.items():
        for t in notices:
            cases.append((n, f"# {t}\n\n{prose}", "a/b.py"))
            half = t.split()
            cases.append((n, "// " + " ".join(half[: len(half) // 2]) + "\n// " + " ".join(half[len(half) // 2 :]) + f"\n\n{prose}", "c.js"))
    for copies in (1, 30):
        plain = [(10_000 + k, f"the {w} of a {w} is to be that it was for this or all word{k}", None) for k in range(100 * copies) for w in [f"w{k % 97}"]]
        found = {r[0]: r[2] for r in run(spark, [(k, t, f"{k}/{p}") for k, (_, t, p) in enumerate(cases)] + plain)}
        wrong = [(n, found[k], t[:90]) for k, (n, t, _) in enumerate(cases) if found[k] != n]
        assert not wrong
        assert not any(found[r[0]] for r in plain)


def test_whole_licences_equal_brute_force(spark):
    rows = [(k, "\r\n".join([openings(n), "", "text below"]), f"{k}/LICENSE") for k, n in enumerate(sorted(lc.TEXTS))]
    rows += [(50 + k, wrapped(lc.TEXTS[n], "*") + "\n\n \t\nend", f"{k}/a.c") for k, n in enumerate(("MIT", "ISC", "BSD-3-Clause"))]
    rows += [(60, lc.TEXTS["MIT"] + "\nSPDX-License-Identifier: ISC\n", "z/LICENSE"), (61, "*\n*\n\n\n", "z/b"), (62, "Released\n\runder\rthe MIT\r\nLicense\n\n\n.", "y/c")]
    assert run(spark, rows) == rounded(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []


def whole_cosine(line, template, texts):
    """TF-IDF cosine with the true frequency of every word."""
    n, df = len(texts), Counter(w for t in texts for w in set(terms(t)))
    a, b = ({w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(terms(t)).items()} for t in (line, template))
    return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_same_licence_at_every_size(spark):
    line = "It is released under the MIT License for all."
    for n in (200, 3000):
        texts = [line if i % 50 == 0 else f"it is for all of the things under word{i}" for i in range(n)]
        want = max(whole_cosine(line, t, texts) for t in lc.TEMPLATES["MIT"])
        got = [r for r in run(spark, [(i, t, None) for i, t in enumerate(texts)]) if r[2]]
        assert [(r[0], r[2]) for r in got] == [(i, "MIT") for i in sorted(range(0, n, 50), key=lambda i: repr((i,)))]
        assert want > 0.8 and all(abs(r[3] - want) < 2e-6 for r in got)
