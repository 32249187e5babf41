import numpy as np
import pandas as pd
import pytest

from barloom.operators import performance as Perf
from tests.helpers import day

SCHEMA = "portfolio_id string, trade_date date, equity double"


def test_sparse_series_uses_elapsed_time(spark):
    rows = [("p", day("2021-01-01"), 100.0), ("p", day("2022-01-01"), 110.0),
            ("p", day("2023-01-01"), 121.0)]
    row = Perf.performance(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["cagr"] == pytest.approx(0.10, abs=1e-3)
    assert row["annual_volatility"] < 0.1
    assert row["calmar"] is None


def test_flat_series_has_no_sharpe_and_short_series_no_row(spark):
    rows = [("flat", day(f"2024-01-{i:02d}"), 5.0) for i in range(1, 6)]
    rows.append(("short", day("2024-01-01"), 5.0))
    got = Perf.performance(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["portfolio_id"] for r in got] == ["flat"]
    assert got[0]["sharpe"] is None and got[0]["total_return"] == 0


def test_duplicate_dates_fail(spark):
    rows = [("p", day("2024-01-01"), 5.0), ("p", day("2024-01-01"), 6.0)]
    with pytest.raises(Exception, match="duplicate date"):
        Perf.performance(spark.createDataFrame(rows, SCHEMA)).collect()


def test_matches_pandas_formulas(spark):
    rng = np.random.default_rng(2)
    days = pd.bdate_range("2020-01-01", periods=600)
    values = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, .01, 600))), index=days)
    rows = [("p", d.date(), float(v)) for d, v in values.items()]
    row = Perf.performance(spark.createDataFrame(rows, SCHEMA), risk_free=0.02).first()
    returns = values.pct_change().dropna()
    years = (days[-1] - days[0]).days / 365.25
    annual = min(252.0, len(returns) / years)
    rf = 1.02 ** (1 / annual) - 1
    assert row["sharpe"] == pytest.approx((returns.mean() - rf) / returns.std() * annual**0.5)
    assert row["max_drawdown"] == pytest.approx((values / values.cummax() - 1).min())


def test_empty_months_carry_a_zero_return(spark):
    rows = [("p", day("2024-01-10"), 100.0), ("p", day("2024-01-31"), 110.0),
            ("p", day("2024-04-02"), 121.0)]
    got = Perf.period_equity_returns(spark.createDataFrame(rows, SCHEMA), "month")
    table = {r["period_end"]: r["ret"] for r in got.collect()}
    assert table == {day("2024-01-31"): pytest.approx(0.1), day("2024-02-29"): 0.0,
                     day("2024-03-31"): 0.0, day("2024-04-30"): pytest.approx(0.1)}


def test_benchmark_needs_full_coverage(spark):
    equity = spark.createDataFrame(
        [("a", day("2024-01-02"), 1.0), ("a", day("2024-01-03"), 1.0),
         ("b", day("2024-01-02"), 1.0), ("b", day("2024-01-04"), 1.0)], SCHEMA)
    index = spark.createDataFrame([(day("2024-01-02"), 10.0), (day("2024-01-03"), 11.0)],
                                  "trade_date date, close double")
    got = Perf.aligned_benchmark(equity, index, 1000.0).orderBy("trade_date").collect()
    assert [(r["portfolio_id"], round(r["equity"], 6)) for r in got] == [("a", 1000.0), ("a", 1100.0)]
    gaps = Perf.benchmark_gaps(equity, index).collect()
    assert [(r["portfolio_id"], r["missing_dates"]) for r in gaps] == [("b", 1)]


def test_portfolio_without_trades_reports_zeros(spark):
    equity = spark.createDataFrame([("a", day("2024-01-02"), 1.0)], SCHEMA)
    trades = spark.createDataFrame(
        [], "portfolio_id string, side string, notional double, commission double, tax double")
    row = Perf.trade_summary(trades, equity).first()
    assert (row["orders"], row["cost"], row["turnover"]) == (0, 0.0, 0.0)
