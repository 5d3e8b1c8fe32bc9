"""The catalogue: every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from mlframe.queries import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query_against_sql(spark, duck, name):
    df = catalogue()[name].run(spark, DIR)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = duck.sql(catalogue()[name].sql)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert got == plain(tuple(r[k] for k in order) for r in want.fetchall())


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["rows"] > 0 and row["r2"] >= 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
