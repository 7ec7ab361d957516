"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normalized

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not present")
# Slow by nature (they run streams or write tables) and covered by their own tests.
WRITERS = ("A8_", "A9_", "I1_", "I2_", "I3_", "I5_", "I6_server_state_stream", "I8_rolling", "I9_", "I10_", "O")
NAMES = [n for n in entry.queries() if not n.startswith(WRITERS)]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert rows
        return
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normalized(rows, df.columns) == normalized(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
