"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    without = set(contract.queries()) - set(contract.oracle_sql()) - set(contract.LLM_QUERIES)
    assert without == {"rouge_l_pairs"}


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, db, name):
    frame = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    if name in contract.oracle_sql():
        answer = db.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == sorted(frame.columns)
        assert rows_of(frame.columns, rows) == rows_of(columns, answer.fetchall())
