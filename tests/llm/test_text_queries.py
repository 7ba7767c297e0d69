"""The registered text queries and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from cadastra.llm import decontaminate, lines, minhash
from cadastra.llm.queries import ORACLES, QUERIES
from cadastra.session import materialize


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_keep_their_promises(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, data_dir), "stage")
        assert out.columns == names and 0 < out.count() <= docs.count(), name
        docs = out
    benchmark = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    assert decontaminate.report(docs, benchmark).filter("contaminated").isEmpty()
    assert minhash.near_duplicates(docs, corpus_pipeline.SHINGLE_WORDS).filter("NOT kept").isEmpty()
    assert lines.report(docs).filter("n_removed > 0").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
