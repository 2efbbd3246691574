"""Rows of a Spark query against rows of its SQL in DuckDB."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool | str) or v is None:
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(float(v), 6)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_equal(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names, want = rows([d[0] for d in found.description], found.fetchall())
    mine, got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert mine == names
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
