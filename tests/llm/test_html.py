import pyarrow as pa  # noqa: F401

from corpusloom.llm import crf
from corpusloom.llm import html_content as hc


def test_blocks():
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav class='menu'><a href=x>Home</a> <a>More</a></nav><p>One <b>bold</b>\n text<p>Two<ul><li>a<li>b</ul><script>var x = '<p>no</p>';</script><!-- <p>c --><div>end</div></body>"
    got = hc.blocks(page)
    assert [b[0] for b in got] == ["T & U", "Home More", "One bold text", "Two", "a", "b", "end"]
    assert "nav" in got[1][1] and got[1][2] and got[1][3] == len("HomeMore")
    assert "p" not in got[4][1] and got[5][1] == got[4][1]


def test_damage_never_fails():
    for page in ("", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='", "text only", "<p>\x00</p>", "<![CDATA[x]]>", "<" * 2000, "<p>" * 3000 + "x", "&#xZZ; &amp"):
        assert all(b[0] for b in hc.blocks(page))
        assert hc.features(hc.blocks(page)).shape[1] == hc.FEATURES


def truth(pages, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    import re

    for r in pages.collect():
        m = re.search(r"/([0-9]{1,18})(?:[.?#/]|$)", r.url)
        if m and int(m[1]) in texts:
            known = {" ".join(x.split()) for x in texts[int(m[1])].split("\n")} - {""}
            found = hc.blocks(r.html)
            y = [t in known and "title" not in tags for t, tags, _, _ in found]
            if any(y):
                yield r.page_id, found, y


def test_held_out_accuracy(spark):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    m = hc.fit(pages.where("page_id % 2 = 0"), docs)
    assert m.trained
    hits = total = 0
    import numpy as np

    for _, found, y in truth(pages.where("page_id % 2 = 1"), docs):
        got = crf.viterbi((hc.features(found).astype(np.float64) @ np.array(m.w)).tolist(), m)
        hits += sum(a == b for a, b in zip(got, y, strict=True))
        total += len(y)
    assert total > 200 and hits >= 0.95 * total


def test_defined_cases(spark, sf):
    pages, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents"))
    m = hc.fit(pages, docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p></p>", "x"), (4, "<p>Only words here.</p>", "x"), (4, "<p>Only words here.</p>", "x"), (None, "<p>null id</p>", "x"), (5, "<p>" + "word " * 60_000 + "</p>", "x")]
    df = spark.createDataFrame([(i, "http://x/1", h, x) for i, h, x in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in hc.extract_pages(df, m).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[1][0].text is None and got[2][0].text == "" and got[3][0].n_blocks == 0 and len(got[4]) == 2 and len(got[None]) == 1 and got[5][0].n_blocks == 1
    none = hc.fit(df.where("page_id > 50"), docs)
    assert not none.trained
    assert hc.extract("<p>a</p><p>b</p>", none) == ("a\nb", 2, 2)
    assert hc.extract_pages(df.where("page_id > 50"), m).count() == 0
