from __future__ import annotations

import duckdb
import pytest

from sparkloom import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "orders", "events"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def same(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = q.queries()[name](spark, DATA)
    want = duck.sql(q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda listed, names: sorted(tuple(same(r[names.index(c)]) for c in columns) for r in listed)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(q.queries()) <= set(e.queries()) and set(q.oracle_sql()) <= set(e.oracle_sql())
