"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from canopy.plans import registry


def _rows(frame):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x.item() if hasattr(x, "item") else str(x) if not isinstance(x, (int, bool)) else x

    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=str)


#: Queries whose operators have brute-force or literal tests of their own: orders of matrices, paths of any length.
TESTED_ELSEWHERE = {"matrix_order_regions", "matrix_order_nations", "pairwise_in_order", "best_paths", "structure_feedback"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    frame = registry.queries()[name](spark, sf_dir)
    frame = frame.select(*sorted(frame.columns)).toPandas()
    sql = registry.oracle_sql().get(name)
    assert sql is not None or name in TESTED_ELSEWHERE
    if sql is None:
        assert len(frame) > 0
    else:
        want = duck.execute(sql).fetchdf()
        want = want[sorted(want.columns)]
        assert list(frame.columns) == list(want.columns)
        assert _rows(frame) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
