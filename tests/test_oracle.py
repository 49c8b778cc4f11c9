"""Every query that has SQL against DuckDB over the smallest tables; the others run and keep their schema."""

import math
import os

import duckdb
import pytest

from spotlattice.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([cell(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    out = duck.execute(catalog.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert got and all(any(r[c] is not None for r in got) for c in df.columns if c not in ("trace", "marker"))
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)
    assert sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) == sorted(map(str, got))  # and again the same


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
