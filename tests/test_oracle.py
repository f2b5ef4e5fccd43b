"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import re
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        if f.endswith(".parquet"):
            path = f"{FOLDER}/{f}"
            con.execute(f"create view {f[:-8]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple(map(repr, r)))


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cur = db.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, cur.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not re.match(r"p\d+_", n)) or ["none"])
def test_others_run(spark, name):
    if name != "none":
        assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
