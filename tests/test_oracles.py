"""Every registered query against its DuckDB oracle on the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from logweave.sources.tables import TABLES

from .conftest import SF_SMALL

SQLS = E.oracle_sql()
NAMES = sorted(SQLS)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return v


def _bag(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_docstring_and_most_have_oracles():
    qs = E.queries()
    assert len(qs) > 100
    assert all(fn.__doc__ for fn in qs.values())
    assert len(SQLS) >= 0.8 * len(qs)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(SQLS[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(dcols, res.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() >= 0
