"""The registered queries against SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
import verify  # noqa: E402
from twinledger.checks import ORACLE, QUERIES  # noqa: E402
from twinledger.model import RULESET_DIFF_COLUMNS  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in verify.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == RULESET_DIFF_COLUMNS and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [
    "reconcile_ruleset", "reconcile_unified", "reconcile_ruleset_without_rules", "full_outer_classify", "classify_counts",
    "matches_operator", "execute_matched_pair_rules", "windowed_reconcile", "last_run", "result_lookup", "infer_schema",
    "relevance_search", "redact_secrets", "validate_unique_ids",
])
def test_query_agrees_with_sql(spark, con, name):
    report = verify.compare(spark, con, name, SF)
    assert report.startswith("ok"), report
