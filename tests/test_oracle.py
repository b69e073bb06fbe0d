"""Every query of the entry point against its SQL, on the smallest tables."""

import collections
import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = collections.Counter(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = collections.Counter(repr(tuple(norm(r[i]) for i in at)) for r in result.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r["rank"] for r in rows) - 1) < 1e-4


def test_without_sql(spark):
    assert QUERIES["bicameral_waves"](spark, DATA).first().waves >= 1
    assert QUERIES["directory_map"](spark, DATA).count() > 0
