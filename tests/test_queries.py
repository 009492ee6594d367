"""Registered queries against their SQL in DuckDB (all of them with MASKWELL_ALL=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "detect_bearer_token mask_partial_credit_card scrub_label scrub_overlap scrub_pages policy_overlay "
    "event_policy allowlist_join custom_mask_native custom_mask_python profile_overlay standard_patterns "
    "scrub_fields_report findings_filter sample_table kpi_bucket last_24h audit_text batch_totals "
    "scrub_json_typed scrub_csv_cells sink_union_csv sink_audit_json tokens_continue tokens_document "
    "stream_scrub stream_summary stream_tokens stream_tokens_batches stream_allowlist tree_errors long_values "
    "long_files json_schema_data_keys"
).split()
NAMES = list(entry_point.QUERIES) if os.environ.get("MASKWELL_ALL") else QUICK


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(entry_point.QUERIES) == set(entry_point.ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    got = entry_point.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expect = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == expect


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.columns == ["pattern", "count"] and out.count() > 0
