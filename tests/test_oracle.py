"""Every registered query against its SQL twin."""

import duckdb
import pytest

import __spark_entry__
from glycoflow.plans.oracle import ORACLE_SQL
from glycoflow.plans.queries import QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _norm(v):
    """As they stand: both sides round to four places, and sums are made so that both get the same number."""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    sql = con.sql(ORACLE_SQL[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in sql.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())


def test_clusters(spark):
    rows = QUERIES["cluster_days"](spark, DIR).collect()
    assert len({r["cluster_id"] for r in rows}) == 5 and all(r["distance"] >= 0 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["cluster_days"](spark, DIR).collect()))
