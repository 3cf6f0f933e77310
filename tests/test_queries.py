"""Every registered query of the library against its SQL at the smallest scale."""

import math

import duckdb
import pytest

from colligo.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(bool(v)) if isinstance(v, bool) else f"{round(float(v), 9) + 0.0}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
