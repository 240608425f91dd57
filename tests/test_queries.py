"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import datetime
import decimal
import math

import duckdb
import pytest
from colligo.plans import queries, report_queries, stored_queries

QUERIES, SQL = queries.QUERIES | report_queries.QUERIES | stored_queries.QUERIES, queries.SQL | report_queries.SQL | stored_queries.SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name not in SQL:
        assert got
        return
    result = db.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
