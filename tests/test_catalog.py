"""Every query of the catalogue against DuckDB."""

import math

import duckdb
import pytest

from sluice.catalog import ORACLE_SQL, QUERIES
from sluice.plans import dashboard  # noqa: F401  it registers its queries
from sluice.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    cell = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
