"""Queries with a DuckDB text give its rows; the others run and give one row per input row where that is the contract."""

import duckdb
import pytest

import __spark_entry__ as E
from rankloom.llm import queries as Q

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    df = Q.QUERIES[name](spark, small_dir)
    rel = con.execute(Q.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in rel.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


def test_every_operator_is_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
