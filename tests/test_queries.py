"""Registered queries against their SQL oracles on the smallest data."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
# The text queries have tests of their own.
TEXT = {n for n in QUERIES if n == "pipeline" or re.match(r"op\d+_", n)}
NAMES = sorted(QUERIES if os.environ.get("CADASTRA_ALL_QUERIES") else set(QUERIES) - TEXT)


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def test_every_query_has_an_oracle():
    assert set(QUERIES) - TEXT <= set(ORACLES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    rows = df.collect()
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(canonical(r[c]) for c in order) for r in rows), key=repr)
    want = sorted((tuple(canonical(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() == 36
