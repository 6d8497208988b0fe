"""Every registered query that has SQL is compared with it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from matchweave.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "nation", "documents", "pages", "benchmark", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
