"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from check_oracle import TABLES, rows
from lorequery.plans.catalog import QUERIES
from lorequery.plans.oracle import SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    assert got
    if name in SQL:
        out = database.sql(SQL[name])
        columns = out.columns
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, out.fetchall())


def test_stream_answers_reads_a_table_that_is_a_folder(spark, tmp_path):
    from lorequery.plans.catalog import QUERIES as found

    rows = [(c, t, "assistant" if t % 2 else "user", f"w{c} w{t} w{c * t % 3}") for c in range(3) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.request_id, r.user) for r in found["stream_answers"](spark, str(tmp_path)).collect()}
    assert got == {(str(c * 1000 + t), text) for c, t, role, text in rows if role == "user"}
