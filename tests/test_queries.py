"""Every query with SQL gives the same rows as the SQL."""

import duckdb
import pytest

from helixframe.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
