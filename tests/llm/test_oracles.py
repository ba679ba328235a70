"""The queries that SQL can express, against their SQL over whole tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in ("benchmark", "conversations", "documents", "pages"):
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER)
    columns = sorted(ours.columns)
    assert columns == sorted(duck.sql(ORACLE_SQL[name]).columns)
    listed = ",".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"select {listed} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, expected))
