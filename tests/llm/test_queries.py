"""Registered queries against their SQL, and the ones without SQL for whole results."""

import duckdb
import pytest

import __spark_entry__ as entry
from quizloom.llm import queries

SQL = queries.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", ["op2_language_id", "op3_document_fingerprints", "op4_quality_classifier", "op5_byte_bpe", "op12_tokenizer_alignment"])
def test_one_row_per_document(name, spark):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(ids)


def test_names():
    found = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 14)) and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)
