"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from brambleflow.plans import recall, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLES | recall.SLOW_ORACLES))
def test_equals_sql(spark, duck, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute((registry.ORACLES | recall.SLOW_ORACLES)[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(x) for x in row) for row in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - set(recall.SLOW_ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(5).count() > 0
