"""Driver-style check: every query with an oracle equals the DuckDB SQL on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from sardonyx.plans.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL

TABLES = ["documents", "labels", "pages", "embeddings", "conversations", "benchmark"]


def _norm(rows):
    def v(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return x
    return sorted((tuple(v(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


CHEAP = list(ORACLE)


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _norm(got) == _norm(exp)


def test_entry_has_seven_domains(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 7


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ORACLE])
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
