"""Every registered query against its SQL, on the small tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(duck.sql(ORACLES[name]).df())


def test_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
