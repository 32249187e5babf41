import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import normalize as N
from barloom.operators import minute as M, quality as Q
from barloom.schema import MINUTE_BAR


def minutes(spark, rows, symbol="000001.SZ", asset="stock", auction=()):
    """rows: (clock, open, high, low, close)."""
    out = []
    for clock, *prices in rows:
        when = dt.datetime.fromisoformat(f"2024-01-02 {clock}")
        out.append((symbol, asset, "1min", when.date(), when, *map(float, prices), 1.0, 1.0,
                    clock in auction, "t"))
    return spark.createDataFrame(out, MINUTE_BAR)


def test_resampling_does_not_bridge_lunch(spark):
    data = minutes(spark, [("11:29", 1, 2, 1, 2), ("11:30", 2, 3, 2, 3), ("13:01", 10, 11, 10, 11)])
    rows = M.resample(data, "5min").orderBy("bar_time").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in rows] == [(1, 3, 2), (10, 11, 1)]
    assert [str(r["bar_time"])[11:16] for r in rows] == ["11:30", "13:05"]


def test_reopening_bar_joins_the_first_afternoon_bucket(spark):
    data = minutes(spark, [("13:00", 1, 2, 1, 2), ("13:05", 2, 3, 2, 3), ("13:10", 3, 4, 3, 4),
                           ("13:15", 4, 5, 4, 5)])
    rows = M.resample(data, "15min").collect()
    assert len(rows) == 1
    assert str(rows[0]["bar_time"]) == "2024-01-02 13:15:00" and rows[0]["open"] == 1


def test_auctions_pass_through(spark):
    data = minutes(spark, [("09:30", 5, 5, 5, 5), ("09:31", 1, 2, 1, 2)], auction=("09:30",))
    rows = M.resample(data, "5min").orderBy("bar_time").collect()
    assert [(str(r["bar_time"])[11:16], r["is_auction"]) for r in rows] == [
        ("09:30", True), ("09:35", False)]


def test_session_grid_edges(spark):
    clocks = ["09:30", "09:31", "11:30", "11:31", "13:00", "15:00", "15:01", "10:00:01"]
    data = minutes(spark, [(c, 1, 1, 1, 1) for c in clocks])
    bad = {str(r["bar_time"])[11:] for r in data.where(Q.off_grid("1min")).collect()}
    assert bad == {"11:31:00", "15:01:00", "10:00:01"}
    etf = minutes(spark, [("09:30", 1, 1, 1, 1)], asset="etf")
    assert etf.where(Q.off_grid("1min")).count() == 1


def test_audit_finds_the_first_reason(spark):
    good = minutes(spark, [("09:31", 1, 1, 1, 1), ("09:32", 1, 1, 1, 1)])
    catalog = M.catalog(good)
    assert Q.minute_audit(good, catalog, "1min").first()["status"] == "valid"
    doubled = good.union(good)
    assert Q.minute_audit(doubled, M.catalog(doubled), "1min").first()["reason"] == "duplicate keys"
    late = good.withColumn("trade_date", F.date_add("trade_date", 1))
    assert Q.minute_audit(late, catalog, "1min").first()["reason"] == "trade date"
    assert Q.minute_audit(good.limit(0), catalog, "1min").first()["reason"] == "missing"


@pytest.mark.parametrize("raw,want", [
    ("sh.600000", "600000.SH"), ("600000", "600000.SH"), ("000985.CSI", "000985.SH"),
    (" 0000 01.sz", "000001.SZ"), ("830001", "830001.SZ"), ("BJ.430001", "430001.BJ")])
def test_minute_symbols(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(N.minute_symbol(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw,want", [
    ("1", "000001.SZ"), ("600000.XX", "600000.SH"), ("430001", "430001.BJ"), ("8", "000008.SZ"),
    ("1234567", "1234567.SZ")])
def test_stock_symbols(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(N.stock_symbol(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("raw,want", [
    ("20240103", "2024-01-03 00:00:00"), ("2024/1/3 9:31", "2024-01-03 09:31:00"),
    ("20240103 09:31:00", "2024-01-03 09:31:00"), ("20240103093100", "2024-01-03 09:31:00"),
    ("2024-01-03T09:31:00", "2024-01-03 09:31:00"), ("nonsense", None), ("09:31", None),
    ("2024-13-01", None)])
def test_time_parsing(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "x string")
    got = frame.select(N.parse_time(F.col("x"))).first()[0]
    assert (None if got is None else str(got)) == want


def test_b_shares_and_asset_types(spark):
    frame = spark.createDataFrame([("200011.SZ",), ("900901.SH",), ("200011.SH",), ("000001.SZ",)],
                                  "x string")
    assert [r[0] for r in frame.select(N.is_b_share(F.col("x"))).collect()] == [
        True, True, False, False]
    codes = spark.createDataFrame(
        [("399001.SZ",), ("000300.SH",), ("000001.SZ",), ("510300.SH",), ("159915.SZ",)], "x string")
    assert [r[0] for r in codes.select(N.infer_asset_type(F.col("x"))).collect()] == [
        "index", "index", "stock", "etf", "etf"]


def test_display_text_rounds_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, 1.015, -0.001, 0.0, 26222164.285, 1234567890.125, 2.0 ** 45 + 0.375, -3.145, 5e-324]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", N.number_text(F.col("v")).alias("num"), N.percent_text(F.col("v")).alias("pct"),
                       N.fixed_text(F.col("v"), 1).alias("one"), N.fixed_text(F.col("v"), 0).alias("none")).collect()
    for row in got:
        v = row["v"]
        assert tuple(row)[1:] == (f"{v:.2f}", f"{v * 100:.2f}%", f"{v:.1f}", f"{v:.0f}")
    odd = spark.createDataFrame([(None,), (float("inf"),)], "v double")
    assert [tuple(r) for r in odd.select(N.number_text(F.col("v")), N.percent_text(F.col("v"))).collect()] == [
        ("—", ""), ("Infinity", "Infinity%")]
