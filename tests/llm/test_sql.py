"""Queries that SQL can express, against a second engine."""

import duckdb
import pytest

from quillspark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df.notna(), None).apply(lambda r: tuple(map(str, r)), axis=1))
    assert rows(got) == rows(want)
