import random

import pytest

from corpusloom.llm import warc


def frame(spark, raws):
    rows = list(raws)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(bytearray(r) if r is not None else None, "x") for r in rows], "record binary, type string").repartition(3)


def whole(spark, raws):
    return {r.record_id: r for r in warc.reassemble(warc.records(frame(spark, raws))).collect()}


def test_round_trip(spark):
    rng = random.Random(2)
    pages = {f"p{i}": bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 300, 5000]))) for i in range(20)}
    raws = [r for n, b in pages.items() for r in warc.write_records(n, f"http://x/{n}", b, 400, 97)]
    got = whole(spark, raws)
    assert {k: (r.status, bytes(r.body), r.target_uri, r.http_status) for k, r in got.items()} == {f"<urn:{n}>": ("ok", b, f"http://x/{n}", 200) for n, b in pages.items()}
    assert got["<urn:p0>"].n_segments == len(warc.write_records("p0", "u", pages["p0"], 400, 97))


def test_split_file():
    raws = warc.write_records("a", "u", b"x" * 900, 200, 100)
    assert [r.rstrip() for r in warc.split_file(b"".join(raws))] == [r.rstrip() for r in raws]
    assert warc.split_file(b"") == [] and len(warc.split_file(raws[0] + b"garbage")) == 2


def test_defined_cases(spark):
    full = warc.write_records("f", "u", b"y" * 900, 200, 100)
    cut = lambda name: warc.write_records(name, "u", b"y" * 900, 200, 100)
    raws = [*full, full[1]]  # a repeat collapses
    raws += cut("noorigin")[1:]
    raws += [r for k, r in enumerate(cut("gap")) if k != 2]
    raws += cut("nolast")[:-1]
    raws += [r.replace(b"Total-Length: ", b"Total-Length: 9") for r in cut("length")]
    c = cut("conflict")
    raws += [*c, c[1].replace(b"y", b"z")]
    raws += [r.replace(b"Transfer-Encoding: chunked", b"Transfer-Encoding: gzip,chunked").replace(b"64\r\nyyy", b"6g\r\nyyy") for r in warc.write_records("badchunk", "u", b"y" * 100, 4000, 100)]
    raws += [b"nothing", None, b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort", b""]
    raws += [b"WARC/1.0\r\nWARC-Record-ID: <plain>\r\nContent-Length: 5\r\n\r\nhello"]
    raws += [b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi"] * 2
    rows = warc.reassemble(warc.records(frame(spark, raws))).collect()
    by = {r.record_id: r for r in rows if r.record_id}
    assert {k: r.status for k, r in by.items()} == {"<urn:f>": "ok", "<urn:noorigin>": "no origin", "<urn:gap>": "gap", "<urn:nolast>": "gap", "<urn:length>": "length", "<urn:conflict>": "conflict", "<urn:badchunk>": "bad chunk", "<plain>": "ok"}
    assert bytes(by["<urn:f>"].body) == b"y" * 900 and bytes(by["<plain>"].body) == b"hello" and by["<urn:gap>"].body is None
    assert sorted(r.status for r in rows if r.record_id is None) == ["bad record"] * 4 + ["ok"] * 2
    assert warc.reassemble(warc.records(frame(spark, []))).count() == 0


@pytest.mark.parametrize(("raw", "want"), [(b"0\r\n\r\n", b""), (b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n", b"abc"), (b"A\r\n0123456789\r\n0\r\n", b"0123456789")])
def test_dechunk(raw, want):
    assert warc.dechunk(raw) == want


@pytest.mark.parametrize("raw", [b"", b"\r\n", b"-1\r\n", b"5\r\nabc\r\n0\r\n", b"3\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n", b" \r\n"])
def test_bad_chunks(raw):
    with pytest.raises(warc.BadChunk):
        warc.dechunk(raw)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.record_id: (r.target_uri, bytes(r.body).decode()) for r in warc.reassemble(warc.records(warc.from_pages(pages))).collect()}
    assert got == {f"<urn:page:{r.page_id}>": (r.url, r.html) for r in pages.collect()}


def test_files_are_streamed(spark, tmp_path):
    """Plain, gzip with a member a record, one gzip over all, and cut-off files; segments of one page lie in two files."""
    import gzip

    pages = {f"p{i}": (b"<p>%d</p>" % i) * 1500 * (i % 3) for i in range(12)}
    pages["long"] = b"z" * 5_000_000
    raws = [r for n, b in pages.items() for r in warc.write_records(n, f"http://x/{n}", b, 7000 if n != "long" else 6_000_000, 1000)]
    a, b, c = raws[:9], raws[9:16], raws[16:]
    (tmp_path / "a.warc").write_bytes(b"".join(a))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in b))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(c)))
    read = warc.read_files(spark, f"{tmp_path}/*")
    assert sorted(bytes(r.record).rstrip() for r in read.collect()) == sorted(r.rstrip() for r in raws)
    got = {r.record_id: r for r in warc.reassemble(warc.records(read)).collect()}
    assert {k: (r.status, bytes(r.body)) for k, r in got.items()} == {f"<urn:{n}>": ("ok", b) for n, b in pages.items()}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cut.warc.gz").write_bytes(gzip.compress(a[0]) + gzip.compress(a[1])[:-20])
    (tmp_path / "d" / "empty.warc").write_bytes(b"")
    (tmp_path / "d" / "odd.warc").write_bytes(a[2] + b"garbage without a header")
    rows = [bytes(r.record) for r in warc.read_files(spark, f"{tmp_path}/d/*").collect()]
    assert a[0].rstrip() in [r.rstrip() for r in rows] and a[2].rstrip() in [r.rstrip() for r in rows] and b"garbage without a header" in rows
    assert sum(warc.parse_record(r) is not None for r in rows) == 2


def test_repeated_long_records_and_other_columns(spark):
    """A hot identifier: equal repeats of a long record are one; columns named like the operator's own aren't read."""
    raws = warc.write_records("hot", "http://h", b"w" * 300_000, 100_000, 5000) * 40 + warc.write_records("cold", "http://c", b"", 100, 10)
    rows = spark.createDataFrame([(bytearray(r), "r", 1, b"p", True) for r in raws], "record binary, record_id string, number int, payload binary, damaged boolean")
    got = {r.record_id: (r.status, len(r.body)) for r in warc.reassemble(warc.records(rows)).collect()}
    assert got == {"<urn:hot>": ("ok", 300_000), "<urn:cold>": ("ok", 0)}
