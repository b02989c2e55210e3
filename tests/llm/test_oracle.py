"""The numbered queries that have a SQL twin, on a whole small table."""

import duckdb
import pytest

from glycoflow.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, sql = QUERIES[name](spark, DIR), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = sorted(tuple(r) for r in df.select(*sql.columns).collect())
    assert got == sorted(sql.fetchall())
    varied = {"op1_substring_dedup": "n_removed", "op5_quality_rules": "n_repeat_words", "op8_line_dedup": "n_dropped", "op9_minhash": "n_links", "op10_decontamination": "n_hit", "op13_vector_codes": "code"}
    assert len({r[varied[name]] for r in df.select(varied[name]).collect()}) > 1
