"""Every query with SQL against DuckDB on the tables of sf0.01."""

import datetime
import decimal
import os

import duckdb
import pytest

from tallyfold.plans import registry

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if v != v else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    rel = duck.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    """Fits, which SQL cannot express: no value is missing but those that are not known yet; see tests/test_forecast.py."""
    rows = registry.QUERIES[name](spark, DATA).collect()
    assert rows and all(r[c] is not None or c in ("ratio", "p", "adjusted", "rule") for r in rows for c in r.asDict())
