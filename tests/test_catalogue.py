"""Registered queries against their reference SQL in DuckDB on the smallest data set.

One query per family by default; ``BARLOOM_ALL_QUERIES=1`` runs the whole catalogue.
"""

import glob
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import rows

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


CORE = set(importlib.import_module("barloom.plans").ORACLES)
FAMILIES = [
    "a1_period_returns", "a4_return_summary", "a5_daily_review_table", "a6_portfolio_returns",
    "a8_correlation", "a9_resample_5min", "a11_performance", "a12_monthly_returns",
    "a16_symbol_digest", "c1_market_review", "c3_etf_rotation", "c4_logbias", "c5_microcap_rps",
    "c10_portfolio_equity", "c11_fill_table", "c13_completeness", "c15_missing_ranges",
    "c20_directory_report", "c21_status_upsert", "f2_mean_momentum", "f5_ema_logbias",
    "f9_percent_rank", "f13_carry_weights", "j4_active_universe", "j7_incomplete_market_dates",
    "j12_strict_asof_targets", "k7_last_dates", "n8_date_parsing", "n14_suspended_placeholders",
    "s2_read_daily_dates", "s6_zip_archives", "u2_stacked_masters", "v1_validate_bars",
    "v10_minute_audit", "v13_snapshot_deep_check", "w1_daily_upsert", "w6_minute_mirror",
]
NAMES = sorted(CORE) if os.environ.get("BARLOOM_ALL_QUERIES") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, ROOT).toPandas()
    columns, values = rows(got)
    want_columns, want = rows(duck.execute(entry_module.oracle_sql()[name]).df())
    assert columns == want_columns
    assert values == want


def test_every_query_has_sql():
    from barloom.plans import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_returns_the_flagship(spark):
    assert entry_module.entry(spark).count() == 12
