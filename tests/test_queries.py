"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from inkstone.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, base, name):
    df = registry.queries()[name](spark, DIR)
    result = base.execute(registry.oracle_sql()[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(result.fetchall(), [c[0] for c in result.description])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
