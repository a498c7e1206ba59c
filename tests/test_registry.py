"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from millrace.plans import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.9g}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_rows_equal_the_sql(spark, duck, name):
    query, sql = REGISTRY[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry_and_registry():
    import __spark_entry__

    assert set(REGISTRY) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
