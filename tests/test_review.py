import pytest
from pyspark.sql import functions as F

from barloom.constants import BREADTH_BUCKETS, DAY, MONTH, PERIODS, WEEK, YEAR
from barloom.operators import review as R
from tests.helpers import day

SCHEMA = "symbol string, trade_date date, close double"


def _bars(spark, series, days):
    rows = [(s, day(d), float(v)) for s, values in series.items()
            for d, v in zip(days, values, strict=True) if v is not None]
    return spark.createDataFrame(rows, SCHEMA)


DATES = ["2021-12-31", "2022-03-31", "2022-04-08", "2022-04-11"]  # year, month and week end, and a Monday


@pytest.fixture()
def small(spark):
    # day: +25 %, 0 %, -25 %; month: +37.5 %, 0 %, -40 %; year: +10 %, 0 %, -10 %
    return _bars(spark, {"P": [50, 40, 44, 55], "Q": [8, 8, 8, 8], "R": [30, 45, 36, 27]}, DATES)


def test_summary_counts(small):
    anchors = R.review_anchors(small)
    row = R.day_summary(R.period_returns(small, anchors=anchors), anchors).first()
    assert (row["as_of"], row["stocks"], row["up"], row["down"], row["flat"]) == (DATES[3], 3, 1, 1, 1)
    assert row["median_return"] == pytest.approx(0.0)


def test_anchors_and_returns_of_all_periods(small):
    row = R.review_anchors(small).first()
    assert [row[p] for p in (DAY, WEEK, MONTH, YEAR)] == [day(DATES[k]) for k in (2, 2, 1, 0)]
    got = {r["symbol"]: [round(r[p], 9) for p in (DAY, MONTH, YEAR)] for r in R.period_returns(small).collect()}
    assert got == {"P": [0.25, 0.375, 0.1], "Q": [0.0, 0.0, 0.0], "R": [-0.25, -0.4, -0.1]}


def test_as_of_between_bars_uses_the_last_bar(small):
    assert R.review_anchors(small, "2022-04-10").first()["latest"] == day(DATES[2])


def test_missing_anchor_fails(spark):
    with pytest.raises(Exception, match="no bars on or before"):
        R.period_returns(_bars(spark, {"P": [3]}, ["2022-04-08"])).collect()


def test_every_bucket_and_both_sides_of_an_edge(spark):
    # edges belong to the bucket below them: 5 % to the third, -5 % to the fifth
    growth = [0.4, 0.07, 0.02, 0.05, -0.02, -0.07, -0.05, -0.3]
    bars = _bars(spark, {f"S{i}": [80, 80, 200, 200 * (1 + g)] for i, g in enumerate(growth)}, DATES)
    rows = {r["区间"]: r[DAY] for r in R.breadth(R.period_returns(bars)).collect()}
    assert [rows[label] for label, _, _ in BREADTH_BUCKETS] == [1, 1, 2, 1, 2, 1]


def test_bias_against_the_mean_of_25_closes(spark):
    # 24 closes of 10 and one of 35 have the mean 11
    rows = [("P", day(f"2022-05-{i:02d}"), 35.0 if i == 27 else 10.0) for i in range(1, 28)]
    assert R.price_bias(spark.createDataFrame(rows, SCHEMA)).first()["bias"] == pytest.approx(35 / 11 - 1)


def test_nav_returns_on_review_anchors(spark, small):
    # 80 at the end of the year, 120 on the 8th, 90 on the 11th
    rows = [("p", day(DATES[0]), 80.0), ("p", day(DATES[2]), 120.0), ("p", day(DATES[3]), 90.0)]
    nav = spark.createDataFrame(rows, "portfolio_id string, trade_date date, equity double")
    row = R.nav_period_returns(nav, R.review_anchors(small)).first()
    assert row[DAY] == pytest.approx(-0.25) and row[YEAR] == pytest.approx(0.125)


def test_nav_must_be_positive(spark):
    nav = spark.createDataFrame([("p", day(DATES[0]), 0.0)], "portfolio_id string, trade_date date, equity double")
    with pytest.raises(Exception, match="NAV must be positive"):
        R.clean_nav(nav).collect()


def test_any_number_of_indices_stands_before_the_tail(spark, small):
    index = spark.range(1500).selectExpr("id AS ordinal", "concat('I', id) AS name", *[f"0.1D AS `{p}`" for p in PERIODS],
                                         "0.0D AS bias")
    table = R.daily_review_table(R.period_returns(small), index).orderBy("row").collect()
    assert len(table) == 21 + 1500
    assert [r["名称"] for r in table[18:1518:1499]] == ["I0", "I1499"]
    assert [r["名称"] for r in table[-3:]] == ["微盘股（自建等权）", "可转债等权", "我的实盘合计"]


def test_portfolio_refuses_missing_bars_and_prices(spark):
    bars = _bars(spark, {"000001.SZ": [5, 8, 16, 20], "000002.SZ": [None, 3, 6, 9]}, DATES)
    returns = R.period_returns(bars)
    held = spark.createDataFrame([("1", "2"), ("600000", "1")], "symbol string, weight string")
    with pytest.raises(Exception, match="without review bars"):
        R.portfolio_period_returns(returns, held).collect()
    held = spark.createDataFrame([("1", "2"), ("2", "1")], "symbol string, weight string")
    with pytest.raises(Exception, match="lack a price on an anchor"):
        R.portfolio_period_returns(returns, held).collect()
    held = spark.createDataFrame([("1", "3"), ("1.SZ", "x")], "symbol string, weight string")
    row = R.portfolio_period_returns(returns, held).first()
    assert row[DAY] == pytest.approx(20 / 16 - 1)


def test_review_table_keeps_blank_rows(small):
    table = R.daily_review_table(R.period_returns(small)).orderBy("row").collect()
    assert len(table) == 21
    assert table[0]["名称"] == "A股总数量" and table[0][DAY] == "3"
    assert table[14][DAY] == "" and table[-1]["名称"] == "我的实盘合计"
    shares = [float(r[DAY].rstrip("%")) for r in table[4:10]]
    assert sum(shares) == pytest.approx(100, abs=0.03)


def test_bucket_counts_sum_to_the_number_of_returns(spark, small):
    returns = R.period_returns(small)
    buckets = R.breadth(returns)
    for period in PERIODS:
        total = buckets.agg(F.sum(period)).first()[0]
        assert total == returns.where(F.col(period).isNotNull()).count()
