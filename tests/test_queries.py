"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from chronolith import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = Q.oracle_sql()


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: "~" if x is None or (isinstance(x, float) and x != x) else (round(x, 6) if isinstance(x, float) else x)).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    got, want = norm(Q.queries()[name](spark, sf_dir).toPandas()), norm(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert {*Q.queries()} <= {*entry.queries()} and {*entry.oracle_sql()} <= {*entry.queries()}
    assert entry.entry(spark).count() == 20
    assert os.path.exists(entry.__file__)
