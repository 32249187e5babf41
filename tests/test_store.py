import pytest
from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.sources import store, tables
from tests.helpers import day

BARS = "symbol string, trade_date date, open double, high double, low double, close double, volume double"


def daily(spark, symbols, days, close=10.0):
    rows = [(s, day(d), close, close + 1, close - 1, close, 1.0) for s in symbols for d in days]
    return spark.createDataFrame(rows, BARS)


def test_upsert_keeps_the_newest_row(spark, tmp_path):
    root = str(tmp_path / "daily")
    symbols = [f"{i:06d}.SZ" for i in range(40)]
    store.write_daily(daily(spark, symbols, ["2024-01-01", "2024-01-02"]), root, "stock")
    later = [(2, "2024-01-02", 99.0, 1), (3, "2024-01-03", 20.0, 1), (3, "2024-01-03", 21.0, 2)]
    update = None
    for _, when, close, seq in later:
        part = daily(spark, symbols, [when], close).withColumn("seq", F.lit(seq))
        update = part if update is None else update.unionByName(part)
    store.write_daily(update, root, "stock", order=["seq"])
    got = store.read_daily(spark, root)
    assert got.count() == 120
    values = {r["trade_date"]: r["close"] for r in got.select("trade_date", "close").distinct().collect()}
    assert values == {day("2024-01-01"): 10.0, day("2024-01-02"): 99.0, day("2024-01-03"): 21.0}


def test_adjustments_are_segregated(spark, tmp_path):
    root = str(tmp_path / "daily")
    store.write_daily(daily(spark, ["A"], ["2024-01-01"]), root, "stock")
    hfq = daily(spark, ["A"], ["2024-01-01"], 50.0).withColumn("adjustment", F.lit("hfq"))
    store.write_daily(hfq, root, "stock")
    assert store.read_daily(spark, root).first()["close"] == 10.0
    assert store.read_daily(spark, root, adjustment="hfq").first()["close"] == 50.0
    with pytest.raises(Exception, match="unknown adjustment"):
        store.write_daily(daily(spark, ["A"], ["2024-01-01"]).withColumn(
            "adjustment", F.lit("abc")), root, "stock")


def test_asset_type_must_agree(spark, tmp_path):
    frame = daily(spark, ["A"], ["2024-01-01"]).withColumn("asset_type", F.lit("etf"))
    with pytest.raises(Exception, match="expected stock"):
        store.write_daily(frame, str(tmp_path / "d"), "stock")


def test_filters_reach_the_scan(spark, tmp_path):
    root = str(tmp_path / "daily")
    store.write_daily(daily(spark, ["A", "B"], ["2023-12-29", "2024-01-02"]), root, "stock")
    frame = store.read_daily(spark, root, ["A"], "2024-01-01", "2024-12-31").select("close")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trade_date" in plan and "symbol" in plan.split("PushedFilters")[1]
    assert "year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert frame.count() == 1


def test_replace_removes_old_years_and_keeps_other_symbols(spark, tmp_path):
    root = str(tmp_path / "daily")
    store.write_daily(daily(spark, ["A"], ["2022-05-05", "2024-01-02"]), root, "stock")
    store.write_daily(daily(spark, ["B"], ["2024-01-02"]), root, "stock")
    store.replace_daily(daily(spark, ["A"], ["2023-03-03"], 7.0), root, "stock")
    got = sorted((r["symbol"], str(r["trade_date"])) for r in store.read_daily(spark, root).collect())
    assert got == [("A", "2023-03-03"), ("B", "2024-01-02")]
    assert not (tmp_path / "daily/asset_type=stock/adjustment=none/year=2022").exists()


def test_market_caps_merge_and_replace(spark, tmp_path):
    root = str(tmp_path / "basic")
    schema = "symbol string, trade_date date, total_mv double"
    d1, d2 = day("2024-01-02"), day("2024-01-03")
    store.write_daily_basic(spark.createDataFrame([("A", d1, 1.0), ("B", d1, 2.0), ("A", d2, 3.0)], schema), root)
    store.write_daily_basic(spark.createDataFrame([("A", d1, 9.0)], schema), root)
    assert store.read_daily_basic(spark, root).count() == 3
    store.write_daily_basic(spark.createDataFrame([("A", d1, 8.0)], schema), root, replace_dates=True)
    rows = sorted(tuple(r) for r in store.read_daily_basic(spark, root).collect())
    assert rows == [("A", d1, 8.0), ("A", d2, 3.0)]


def test_factors_must_cover_every_bar(spark):
    bars = daily(spark, ["A"], ["2024-01-02", "2024-01-03"], 1.0)
    factor = "symbol string, trade_date date, adj_factor double, seq int"
    full = spark.createDataFrame([("A", day("2024-01-02"), 2.0, 1), ("A", day("2024-01-03"), 9.0, 1),
                                  ("A", day("2024-01-03"), 3.0, 2)], factor)
    got = {str(r["trade_date"]): r["close"] for r in tables.adjust_prices(bars, full).collect()}
    assert got == {"2024-01-02": 2.0, "2024-01-03": 3.0}
    with pytest.raises(Exception, match="no positive factor"):
        tables.adjust_prices(bars, full.where("seq = 1 and adj_factor < 5")).collect()


def test_suspended_bond_needs_confirmation(spark):
    schema = BARS + ", amount double, pre_close double"
    d = day("2024-01-02")
    rows = [("A", d, 0.0, 0.0, 0.0, 5.0, 0.0, None, 5.0), ("B", d, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 5.1),
            ("C", d, 0.0, 0.0, 0.0, 5.0, 1.0, 0.0, 5.0)]
    got = {r["symbol"]: (r["open"], r["suspended"]) for r in tables.fill_suspended(
        spark.createDataFrame(rows, schema)).collect()}
    assert got == {"A": (5.0, True), "B": (0.0, False), "C": (0.0, False)}


def test_json_has_no_non_finite_numbers(spark, tmp_path):
    frame = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    store.write_json(frame, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert "NaN" not in text and "Inf" not in text and text.count("null") == 2


def test_quality_report_and_gate(spark):
    d = day("2024-01-02")
    rows = [("A", d, 1.0, 2.0, 0.5, 1.0, 1.0), ("A", d, 1.0, 2.0, 0.5, 1.0, 1.0),
            (" ", d, 1.0, 2.0, 0.5, 1.0, 1.0), ("B", d, 1.0, 0.9, 0.5, 1.0, 1.0),
            ("C", d, 1.0, float("inf"), 0.5, 1.0, 1.0), ("D", d, 1.0, 2.0, 0.5, 1.0, -1.0),
            ("E", d, float("nan"), 2.0, 0.5, 1.0, 1.0)]
    report = Q.validate_bars(spark.createDataFrame(rows, BARS))
    got = {r["rule"]: r["bad_rows"] for r in report.collect()}
    assert got == {"empty": 0, "required": 2, "duplicate": 1, "ohlc": 2, "trade": 1,
                   "amount_mostly_null": 0}
    with pytest.raises(Q.DataQualityError):
        Q.require_clean(report)
    Q.require_clean(Q.validate_bars(spark.createDataFrame(rows[:1], BARS)))
    with pytest.raises(Q.DataQualityError, match="lack columns"):
        Q.validate_bars(spark.createDataFrame([("A",)], "symbol string"))


def minutes(spark, symbol, *times, close=1.5):
    import datetime as dt

    rows = [(symbol, "stock", "1min", dt.datetime.fromisoformat(t).date(), dt.datetime.fromisoformat(t),
             1.0, 2.0, 0.5, close, 10.0, 100.0, False, "test") for t in times]
    return spark.createDataFrame(rows, (
        "symbol string, asset_type string, frequency string, trade_date date, bar_time timestamp_ntz, open double, "
        "high double, low double, close double, volume double, amount double, is_auction boolean, source string"))


def test_one_symbol_may_be_stock_and_index(spark, tmp_path):
    root = str(tmp_path / "daily")
    both = daily(spark, ["A"], ["2024-01-01"], 5.0).withColumn("asset_type", F.lit("stock")).unionByName(
        daily(spark, ["A"], ["2024-01-01"], 6.0).withColumn("asset_type", F.lit("index")))
    store.write_daily(both, root)
    assert store.read_daily(spark, root).first()["close"] == 5.0
    assert store.read_daily(spark, root, asset_type="index").first()["close"] == 6.0


def test_repeated_keys_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    for k, closes in enumerate(((5.0, 6.0), (6.0, 5.0))):
        root = str(tmp_path / f"daily{k}")
        rows = daily(spark, ["A"], ["2024-01-01"], closes[0]).unionByName(daily(spark, ["A"], ["2024-01-01"], closes[1]))
        store.write_daily(rows, root, "stock")
        assert store.read_daily(spark, root).first()["close"] == 6.0


def test_minute_write_keeps_other_symbols_and_years(spark, tmp_path):
    root = str(tmp_path / "minute")
    store.write_minute(minutes(spark, "000001.SZ", "2023-05-05T09:31", "2024-01-03T09:31", "2024-03-03T09:31"), root)
    store.write_minute(minutes(spark, "000002.SZ", "2024-01-03T09:31"), root)
    store.write_minute(minutes(spark, "000001.SZ", "2024-01-04T09:31"), root)
    got = sorted((r["symbol"], str(r["bar_time"])[:10]) for r in store.minute_store(spark, root).collect())
    assert got == [("000001.SZ", "2023-05-05"), ("000001.SZ", "2024-01-04"), ("000002.SZ", "2024-01-03")]
    store.mirror_minute(minutes(spark, "000001.SZ", "2024-02-01T09:31"), root)
    got = sorted((r["symbol"], str(r["bar_time"])[:10]) for r in store.minute_store(spark, root).collect())
    assert got == [("000001.SZ", "2024-02-01"), ("000002.SZ", "2024-01-03")]


def test_writers_read_only_the_folders_they_touch(spark, tmp_path):
    root = str(tmp_path / "daily")
    store.write_daily(daily(spark, [f"{i:06d}.SZ" for i in range(40)], ["2023-12-29", "2024-01-02"]), root, "stock")
    incoming = store._daily_rows(daily(spark, ["000007.SZ"], ["2024-01-02"]), "stock", None)
    read = store.touched_daily(spark, root, incoming, store.DAILY_PARTITION)
    plan = read._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = plan.split("PartitionFilters")[1].split("PushedFilters")[0].split("ReadSchema")[0]
    assert "(year" in filters and "(bucket" in filters
    assert read.select("bucket").distinct().count() == 1 and read.where("year = 2023").count() == 0


def test_csv_result_has_a_header(spark, tmp_path):
    store.write_csv(spark.createDataFrame([("A", 1.5)], "symbol string, weight double"), str(tmp_path / "c"))
    lines = {line for part in (tmp_path / "c").glob("*.csv") for line in part.read_text().splitlines()}
    assert lines == {"symbol,weight", "A,1.5"}
