"""Every registered query of the engine's own operators against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from millrace.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def text(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float) or type(v).__name__ in ("float64", "float32"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    whole = frame[columns].copy()
    for c in columns:  # a missing number makes pandas read integers as floats
        if whole[c].dtype.kind == "f" and (whole[c].dropna() % 1 == 0).all():
            whole[c] = whole[c].astype("Float64")
        whole[c] = [text(v if v is None or v is pd.NA else float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in whole[c].astype(object)]
    return sorted(whole.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(name, spark, con):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
