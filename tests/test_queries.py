"""Registered queries against their SQL twins on the smallest data.

All queries are compared when ROLLBOOK_ALL_QUERIES is set, otherwise one of each family.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rollbook.plans import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "pair_totals", "owner_month_rollup", "flow_edges", "flow_totals", "five_way_full_outer", "history_timeline", "episode_summary",
    "topk_per_category", "age_buckets", "adjust_snapshot", "vendor_inventory", "validation_diff", "load_rules", "encode_snapshot",
    "filename_to_month", "category_trajectory", "directory_search", "contact_table", "mailbox_flags", "mention_search",
    "news_payload_normalise", "report_lines", "stacked_series", "key_status_card",
    "watch_alerts", "watch_windows", "incremental_rollup", "pair_totals_bucketed", "lookup_search", "adjust_from_files",
    "scan_contacts_csv", "scan_directory_json", "sink_fixed_width", "latest_forecasts", "news_feed", "stub_owners",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def names():
    return list(QUERIES) if os.environ.get("ROLLBOOK_ALL_QUERIES") else list(CHOSEN)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, db, name):
    error, _ = check.compare(entry.queries()[name](spark, SF), db.sql(entry.oracle_sql()[name]))
    assert error is None, error


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
