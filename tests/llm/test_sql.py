"""Registered queries of the training-data operators against their SQL on the smallest tables."""

import duckdb
import pytest

from check_oracle import TABLES, rows
from lorequery.llm.catalog import QUERIES
from lorequery.llm.oracle import SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", SQL)
def test_query(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    out = database.sql(SQL[name])
    columns = out.columns
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, df.collect())
    assert got and got == rows(columns, out.fetchall())
