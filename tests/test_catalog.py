"""Every named query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from groundwell.settings import shared_folder

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = [
        tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
        for r in rows
    ]
    return sorted(tidy, key=repr)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, FOLDER)
    mine = rows_of(frame.columns, frame.collect())
    assert mine, "a query without rows shows nothing"
    if name in oracle_sql():
        result = db.execute(oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert mine == rows_of(columns, result.fetchall())


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_a_query_leaves_no_run_folder(spark):
    shared = Path(shared_folder(spark))
    queries()["search_text"](spark, FOLDER).collect()
    assert not list(shared.glob("search_text-*"))
