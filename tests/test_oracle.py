"""Every query with SQL gives the rows of that SQL on the same tables."""

import math

import duckdb
import pytest

from quizloom.plans import registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (int, str, bool)) or v is None:
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    got_cols = [d[0] for d in cur.description]
    assert sorted(got_cols) == cols
    at = [got_cols.index(c) for c in cols]
    want = _sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    assert _sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))
    # A second run gives the same rows.
    assert _sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())) == _sorted(map(tuple, rows))
