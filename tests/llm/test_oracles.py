"""Queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).itertuples(index=False)))
    assert key(got) == key(want)


def test_every_number_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
