"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from studyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"montecarlo_fwe", "montecarlo_clusters", "focus_counter"}  # no SQL; tests/test_operators.py and test_meta.py have them


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, f"{x:.6f}" if isinstance(x, float) else str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = ordered([tuple(r[c] for c in columns) for r in got.collect()])
    if name not in catalogue.oracle_sql():
        assert rows
        return
    answer = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    want = ordered([tuple(r[answer.columns.index(c)] for c in columns) for r in answer.fetchall()])
    assert len(rows) == len(want) and all(same(x, y) for r, w in zip(rows, want) for x, y in zip(r, w))


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) >= 60
