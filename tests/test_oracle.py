"""Every registered query against its DuckDB oracle on sf0.001 (the same
comparison the driver makes at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest
from tests.conftest import SF_SMALL

# The optional operators have their own tests.
QUERIES = {n: q for n, q in E.queries().items() if q.__module__.startswith("newslake.plans")}
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_a_docstring():
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert name == "model_metrics", "only a fitted model's metrics go without an oracle here"
        r = df.collect()[0]
        assert len(rows) == 1 and r["mcll"] > 0 and 0 <= r["f1"] <= 1 and 0 <= r["auc"] <= 1 and 0 <= r["n_right"] <= r["n_test"]
        assert r["n_test"] > 0
        return
    res = duck.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    d_rows = res.fetchall()
    assert len(rows) == len(d_rows)
    assert digest(df.columns, rows)[0] == digest(cols, d_rows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "overall_score" in df.columns
