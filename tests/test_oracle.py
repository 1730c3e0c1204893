"""Every query against its DuckDB twin on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    opened = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        opened.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return opened


def _in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_search_query_has_an_oracle():
    apart = {name for m in contract._training_data_modules() for name in m.QUERIES}
    assert set(contract.queries()) - apart == set(contract.oracle_sql()) - apart


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, connection, name):
    found = contract.queries()[name](spark, str(DATA))
    wanted = connection.execute(contract.oracle_sql()[name])
    columns = sorted(column[0] for column in wanted.description)
    assert sorted(found.columns) == columns
    order = [[column[0] for column in wanted.description].index(c) for c in columns]
    expected = [tuple(row[at] for at in order) for row in wanted.fetchall()]
    actual = [tuple(row[column] for column in columns) for row in found.collect()]
    assert actual
    assert _in_order(actual) == _in_order(expected)


def test_entry_runs(spark):
    hits = contract.entry(spark)
    assert {"file_path", "score", "highlights"} <= set(hits.columns)
    assert 0 < hits.count() <= 10
