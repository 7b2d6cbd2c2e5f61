"""Every registered query of the network engine against its SQL twin, on the smallest tables."""

from __future__ import annotations

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from fleetnet.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    def value(v):
        if pd.isna(v):
            return None
        number = isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_)
        return round(float(v), 9) + 0.0 if number else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(v) for v in r) for r in df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
