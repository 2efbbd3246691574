"""Sources, sinks, settings, runs, streams."""

import gzip
import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import sinks, sources
from corpusloom.cli import main
from corpusloom.operators import dedup, screen, stats
from corpusloom.plans import builder, config
from corpusloom.sinks import card
from corpusloom.sources import archives, files, tables, web
from corpusloom.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.py": "x = 1\n", "B.md": "# Title\n\nWords of a text.\n", ".hidden": "h", "sub/c.txt": "text c", "sub/skip.log": "l", "sub/keep.log": "k", "node_modules/x.js": "x", "big.txt": "b" * 5000, "odd [1].txt": "odd"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / ".gitignore").write_text("*.log\n!keep.log\n# note\n")
    (root / "link.txt").symlink_to("/etc/hostname")
    return str(root)


def test_walk(tree):
    got = [p for p, _ in files.walk(tree, max_bytes=4000)]
    assert got == ["a.py", "B.md", "odd [1].txt", "sub/c.txt", "sub/keep.log"]
    assert [p for p, _ in files.walk(tree, include=["py"])] == ["a.py"]


def test_ignore_rules():
    r = files.parse_rules("build/\n/top.txt\n**/deep/*.tmp\nx?.md\n")
    assert files.ignored(r, "a/build", True) and not files.ignored(r, "a/build", False)
    assert files.ignored(r, "top.txt", False) and not files.ignored(r, "a/top.txt", False)
    assert files.ignored(r, "a/deep/x.tmp", False)
    assert files.ignored(r, "q/x1.md", False) and not files.ignored(r, "x12.md", False)


def test_local_dir(spark, tree):
    got = {r.path: (bytes(r.content), r.size) for r in sources.load(spark, "local_dir", root=tree, prefix_bytes=3).collect()}
    assert got["a.py"] == (b"x =", 6) and "odd [1].txt" in got and "link.txt" not in got
    assert sources.load(spark, "glob", root=tree, pattern="*.txt", max_bytes=100).count() >= 2
    with pytest.raises(ValueError):
        sources.load(spark, "local_dir", root=tree, nope=1)
    with pytest.raises(ValueError):
        sources.load(spark, "nope")


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return b.getvalue()


def test_zip(spark, tmp_path):
    (tmp_path / "r.zip").write_bytes(zipped({"top/b.txt": "b", "top/A.py": "a", "top/../evil": "e", "top/d/c.txt": "c"}))
    got = [(r.path, bytes(r.content)) for r in sources.load(spark, "zip", path=str(tmp_path / "r.zip")).collect()]
    assert got == [("A.py", b"a"), ("b.txt", b"b"), ("d/c.txt", b"c")]
    with pytest.raises(archives.ArchiveLimit):
        list(archives.members(zipped({"x": "0" * 10**6})))
    with pytest.raises(archives.ArchiveLimit):
        list(archives.members(zipped({str(i): "x" for i in range(5)}), max_members=4))
    assert archives.safe_path("/abs") is None and archives.safe_path("C:/x") is None and archives.safe_path("a//./b") == "a/b"


def test_jsonl(spark, tmp_path):
    lines = ["[1]", '"s"', "5", '{"text": "one", "meta": {"path": "/..\\\\x\\\\f.md"}}', "{broken", '{"no": 1}', '{"text": "two"}', '{"text": 7}', json.dumps({"text": "x" * 50})]
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    got = sorted((r.text, r.path) for r in sources.load(spark, "jsonl", path=str(tmp_path / "d.jsonl.gz"), max_text_chars=20).collect())
    assert [g[0] for g in got] == ["one", "two"]
    assert got[0][1] == "x/f.md" and got[1][1].startswith("d/")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,Text\n1,"a ""q"" b\nnext"\n2,  \n,c\n')
    got = sorted((r.path, r.text) for r in sources.load(spark, "csv_text", path=str(tmp_path / "t.csv")).collect())
    assert ("1", 'a "q" b\nnext') in got and len(got) == 2
    (tmp_path / "t.tsv").write_text("a\tb\nc\td\n")
    got = sources.load(spark, "csv_text", path=str(tmp_path / "t.tsv"), header=False, text_index=1).collect()
    assert sorted(r.text for r in got) == ["b", "d"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "order" (id INTEGER, "select" TEXT, b TEXT)')
        db.executemany('INSERT INTO "order" VALUES (?, ?, ?)', [(i, f"t{i}", None if i % 2 else " x ") for i in range(20)] + [(99, " ", None)])
    got = {r.path: r.text for r in sources.load(spark, "sqlite", path=path, table="order", text_columns=["select", "b"], id_column="id", label="d").collect()}
    assert len(got) == 20 and got["d:2"] == "t2\n\nx" and got["d:3"] == "t3"
    got = sources.load(spark, "sqlite", path=path, table="order", where="id < 5", text_columns=["select"]).collect()
    assert len(got) == 5
    assert sources.load(spark, "sqlite", path=path, query="SELECT b FROM \"order\" WHERE b IS NOT NULL").count() == 10
    with pytest.raises(ValueError):
        sources.load(spark, "sqlite", path=path, table="order", sha256="00")
    with pytest.raises(ValueError):
        sources.load(spark, "sqlite", path=path)


def test_event_xml(spark, tmp_path):
    xml = '<Events><Event xmlns="u"><System><EventID>5</EventID></System><EventData><Data Name="a">1</Data><Data Name="a">2</Data><Data>n</Data></EventData></Event><Event><broken></Event></Events>'
    (tmp_path / "e.xml").write_text(xml)
    got = [r.event for r in sources.load(spark, "event_xml", path=str(tmp_path / "e.xml")).collect()]
    assert json.loads(got[0]) == {"System": {"EventID": "5"}, "EventData": {"a": ["1", "2"], "_unnamed": ["n"]}}
    assert got[1] is None and tables.event_dict("<x") is None


def test_links(spark):
    html = '<base href="https://b.org/dir/page.html"><a href="x.pdf">1</a><A HREF=\'/y.PDF?q=1#f\'>2</A><a href=x.pdf>3</a><link href="mailto:a@b"><a href="../up/z.pdf">4</a><a href="//o.org/w.pdf">5</a><a href="noext">6</a><a href="q.html">7</a>'
    pages = spark.createDataFrame([(1, "http://a.org/", html), (2, "http://a.org/", None), (3, None, html)], "page_id long, url string, html string")
    got = [r.link for r in web.links(pages).orderBy("position").collect() if r.page_id == 1]
    assert got == ["https://b.org/dir/x.pdf", "https://b.org/y.PDF?q=1", "https://b.org/up/z.pdf", "https://o.org/w.pdf"]
    assert web.links(pages, ambiguous=True).count() == 5
    assert web.links(pages, limit=2).count() == 2
    names = spark.createDataFrame([("a.pdf", 1), ("A.pdf", 2), ("b", 3)], "name string, position int")
    assert [r.name for r in web.unique_names(names).orderBy("position").collect()] == ["a.pdf", "A__2.pdf", "b"]


def test_fetch_policy():
    assert web.is_global("8.8.8.8") and not web.is_global("10.0.0.1") and not web.is_global("::ffff:127.0.0.1") and not web.is_global("x")
    assert web.may_redirect("https://a.org/x", "/y") and not web.may_redirect("https://a.org/", "http://a.org/") and not web.may_redirect("https://a.org/", "https://b.org/")
    assert web.retry_waits(4) == [1, 2, 4]


def test_run(spark, tree, tmp_path):
    c = config.from_dict(
        {
            "sources": [{"kind": "local_dir", "options": {"root": tree}}],
            "sinks": [{"kind": "jsonl", "options": {"path": str(tmp_path / "o1")}}, {"kind": "parquet", "options": {"path": str(tmp_path / "o2"), "partition_by": ["lang"]}}, {"kind": "prompts", "options": {"path": str(tmp_path / "o3")}}],
            "quality": {"mode": "advisory", "dedup": "near"},
            "safety": {"mode": "inline"},
            "languages": True,
            "metadata": {"repo": "me/mine", "license": "MIT"},
        }
    )
    result = builder.run(spark, c)
    assert result.summary["records"] == 6 and result.summary["screeners"]["quality"]["scored"] == 6
    lines = spark.read.json(str(tmp_path / "o1"))
    assert lines.where("meta.kind = 'run_header'").count() == 1
    foot = lines.where("meta.kind = 'run_summary'").first()
    assert json.loads(foot.meta.summary)["summary"]["records"] == 6
    back = sources.load(spark, "jsonl", path=str(tmp_path / "o1"))
    assert {r.path for r in back.where("text <> ''").collect()} == {"a.py", "B.md", "odd [1].txt", "sub/c.txt", "sub/keep.log", "big.txt"}
    assert spark.read.parquet(str(tmp_path / "o2")).where("lang = 'Python'").count() == 1
    assert any("### a.py [chunk 1]" in r.value for r in spark.read.text(str(tmp_path / "o3")).collect())
    text = builder.dataset_card(result, "Mine: a set")
    assert text.startswith("---\npretty_name: \"Mine: a set\"") and "n<1K" in text and "| train | 6 |" in text
    sinks.qc_csv(result.screened, str(tmp_path / "qc"))
    assert spark.read.csv(str(tmp_path / "qc"), header=True).columns[:2] == ["doc_id", "score"]


def test_config(tmp_path):
    for bad in ({"nope": 1}, {"quality": {"mode": "x"}}, {"chunk": {"target": 0}}, {"max_error_rate": 2}, {"sinks": [{"kind": "x"}]}, {"sinks": [{"kind": "jsonl", "options": {"path": "a"}}, {"kind": "parquet", "options": {"path": "a"}}]}, {"quality": {"heuristics": {"gopher_weight": -1}}}):
        with pytest.raises((ValueError, TypeError)):
            config.from_dict(bad)
    (tmp_path / "c.toml").write_text('[[sources]]\nkind = "jsonl"\noptions = {path = ["a", "b", "c"]}\n[[sinks]]\nkind = "jsonl"\noptions = {path = "o"}\n')
    c = config.load(str(tmp_path / "c.toml"))
    assert config.from_dict(config.to_dict(c)) == c
    parts = config.shards(c, 0, "path", ["a", "b", "c"], 2)
    assert [p.sources[0].options["path"] for p in parts] == [["a", "b"], ["c"]]
    assert len({p.sinks[0].options["path"] for p in parts}) == 2


def test_cli_shard(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"sources": [{"kind": "jsonl"}], "sinks": [{"kind": "jsonl", "options": {"path": "o"}}]}))
    (tmp_path / "t").write_text("a\nb\n\nc\n")
    assert main(["shard", str(tmp_path / "c.json"), str(tmp_path / "t"), "path", "2", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out/shard-00001.json").read_text())["sources"][0]["options"]["path"] == ["a", "b"]


def test_card_yaml():
    assert card.yaml({"a": [1, "x: y"], "b": {"c": True}, "d": []}) == 'a:\n  - 1\n  - "x: y"\nb:\n  c: true\nd: []'
    assert card.human_bytes(2048) == "2.0 KB"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"doc_id": str(i), "text": f"text number {i % 3} with words", "ts": "2024-01-01T00:0%d:00" % i} for i in range(6)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.unique(ingest.read(spark, str(src))).writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("uniq").count() == 3
    store = dedup.Store(spark, str(tmp_path / "store"))
    q = ingest.into_store(ingest.read(spark, str(src)), store, str(tmp_path / "out"), str(tmp_path / "c2"), {"availableNow": True})
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count_distinct("text")).first()[0] == 3
    assert store.signatures().count() == 3


def test_transforms_and_error_rate(spark, tree, tmp_path):
    c = config.from_dict({"sources": [{"kind": "local_dir", "options": {"root": tree, "include": [".txt"], "max_bytes": 100}}], "max_error_rate": 0.1})
    seen = builder.run(spark, c, before=(lambda d: d.where("meta.path like 'sub/%'"),), after=(lambda d: d.withColumn("text", F.upper("text")),))
    assert [r.text for r in seen.records.collect()] == ["TEXT C"]
    rows = spark.createDataFrame([("a",), (None,)], "text string")
    with pytest.raises(stats.ErrorRate):
        stats.enforce_error_rate(rows, F.col("text").isNull(), 0.4)
    stats.enforce_error_rate(rows, F.col("text").isNull(), 0.5)
    stats.enforce_error_rate(rows.where("text = 'none'"), F.col("text").isNull(), 0.0)


def test_filled_licences_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "n int, repo string")
    assert {r.n: r.repo for r in builder.filled(files, "repo", F.lit("mine")).collect()} == {1: "mine", 2: "x", 3: "mine"}
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("# SPDX-License-Identifier: BSD-3-Clause\nx = 1\n")
    (src / "clip.png.txt").write_text("words of a caption\n")
    taken = tmp_path / "taken"
    taken.mkdir()
    one = {"kind": "local_dir", "options": {"root": str(src)}}
    c = {"sources": [one], "find_licences": True, "sinks": [{"kind": "parquet", "options": {"path": str(taken)}}, {"kind": "parquet", "options": {"path": str(tmp_path / "new")}}]}
    result = builder.run(spark, config.from_dict(c))
    assert {r[0] for r in result.records.select("meta.license").collect()} == {"BSD-3-Clause"}
    assert list(result.failures) == [str(taken)] and result.summary["sink_errors"] == 1
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2
    named = builder.run(spark, config.from_dict(c | {"metadata": {"license": "MIT"}, "sinks": []}))
    assert {r[0] for r in named.records.select("meta.license").collect()} == {"MIT"}
    with pytest.raises(Exception, match="exist"):
        builder.run(spark, config.from_dict(c | {"sinks": c["sinks"][:1]}))
    with pytest.raises(ValueError, match="metadata"):
        config.from_dict({"metadata": {"text": "x"}})


def test_card_modalities(spark):
    rows = spark.createDataFrame([("a.PNG",), ("d/b.csv",), (None,)], "path string")
    meta = F.struct("path", *[F.lit("x").alias(c) for c in ("language", "license", "kind")], F.lit(1).alias("bytes"))
    found = card.merge(card.fragment(rows.select(meta.alias("meta")), "f")).first()
    assert found.modalities == ["image", "tabular", "text"] and found.num_examples == 3
    empty = card.merge(card.fragment(rows.where("path = 'x'").select(meta.alias("meta")), "f")).first()
    assert empty.modalities == ["text"]


def test_git_context(tmp_path):
    assert files.git_context(str(tmp_path)) == {}
    (tmp_path / ".git").mkdir()
    for url in ("https://user:secret@example.com/me/mine.git", "git@example.com:me/mine.git", "ssh://git@example.com:22/me/mine"):
        (tmp_path / ".git/config").write_text(f'[core]\n\tbare = false\n[remote "origin"]\n\turl = {url}\n')
        assert files.git_context(str(tmp_path)) == {"repo": "me/mine", "repo_url": "https://example.com/me/mine"}


def test_modalities(spark):
    rows = spark.createDataFrame([([".py", ".png"],), ([".mp3"],), ([],)], "e array<string>").select(stats.modalities(F.col("e")).alias("m"))
    assert [r.m for r in rows.collect()] == [["image", "text"], ["audio"], ["text"]]
    assert sources.load_plugins("no.such.group") == []


def test_merge_screeners_and_perplexity(spark):
    parts = spark.createDataFrame([("q", 5, 3), ("q", 2, None), ("s", 1, 1)], "screener string, scored long, kept long")
    assert sorted(map(tuple, screen.merge_counts(parts).collect())) == [("q", 7, 3), ("s", 1, 1)]
    df = spark.createDataFrame([(1, "some text", 20.0), (2, "some text", None)], "doc_id long, text string, ppl double")
    got = [r.score for r in screen.quality(df, perplexity="ppl").orderBy("doc_id").collect()]
    assert got[0] == pytest.approx(got[1])
