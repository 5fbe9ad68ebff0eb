"""Every core query with SQL agrees with DuckDB on the same files; the others run and keep their columns."""

import collections
import datetime
import decimal
import glob

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {k: f for m in entry._CORE for k, f in __import__(m, fromlist=["x"]).QUERIES.items()}
SQL = {k: s for m in entry._CORE for k, s in __import__(m, fromlist=["x"]).ORACLE.items()}
SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        r = duck.execute(SQL[name])
        columns = [c[0] for c in r.description]
        want = r.fetchall()
        assert sorted(df.columns) == sorted(columns)
        assert bag(got, df.columns) == bag(want, columns)


def test_entry_runs_and_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
