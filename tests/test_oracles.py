"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parent.parent / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
CHOSEN = ["agency_scorecard", "agency_issue_bottlenecks", "area_metrics", "grid_persistence", "quintiles", "matched_gaps",
          "full_rule_list", "mix_shift", "classification_report", "ngram_documents", "describe_durations"]


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, connection, name):
    result = entry.queries()[name](spark, SF).toPandas()
    assert check.difference(result, connection.execute(entry.oracle_sql()[name]).df()) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
