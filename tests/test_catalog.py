"""Registered queries against their SQL twins.  All of them with FULL=1, otherwise one per area."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
import check
from driftmeter.testbed import catalog, oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "source_tree_scan", "function_csv_source", "snapshot_json_write", "metrics_tables_write", "chart_series_sink",
    "sloc_by_file", "coupling_by_file", "entropy_by_commit", "severity_bands", "percentile_position",
    "drift_verdict_as_of", "observations", "delta_contributors", "top_scan_chart", "incremental_scan_stream",
]


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in check.TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return database


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracles.statements())
    assert set(catalog.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES) if os.environ.get("FULL") else SAMPLE)
def test_query_equals_sql(spark, connection, name):
    verdict = check.compare(spark, SF, name, connection)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert contract.entry(spark).count() > 0
