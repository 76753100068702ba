"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from stockloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "-"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(catalog.ORACLE_SQL[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == columns
    order = sorted(range(len(theirs)), key=lambda i: theirs[i])
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
