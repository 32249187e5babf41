"""Bars, market caps, minute bars, NAV and masters derived from the generic input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.constants import BAR_VALUES


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _cents(value: str) -> Column:
    """Two-decimal money as whole cents: exact to add up and cheap to aggregate."""
    return F.rint(F.col(value) * 100).cast("bigint")


def money(value: str) -> Column:
    return F.sum(_cents(value)) / 100


_PRICE_DIGITS = 10**9


def bars(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars of 20 synthetic symbols from ``lineitem``.

    Open and close are the first and last price in (order, line, price) order. That order packs
    into one decimal whose low digits are the price, so both are plain min/max hash aggregates.
    """
    digits = F.lit(_PRICE_DIGITS).cast("decimal(10,0)")
    place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(19,0)")
    lines = table(spark, root, "lineitem").select(
        F.pmod("l_suppkey", F.lit(20)).cast("int").alias("k"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        place.alias("place"),
        _cents("l_extendedprice").alias("px"),
        _cents("l_quantity").alias("qty"),
    )
    seq = (F.col("place") * digits + F.col("px").cast("decimal(10,0)")).cast("decimal(38,0)")
    daily = lines.groupBy("k", "trade_date").agg(
        F.min(seq).alias("first_seq"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max(seq).alias("last_seq"), F.sum("qty").alias("volume"), F.sum("px").alias("amount"),
    )

    def price(packed: str) -> Column:
        return F.pmod(F.col(packed), digits).cast("double") / 100

    k = F.col("k")
    head = (
        F.when(k < 2, "688").when(k == 2, "830").when(k == 3, "430").when(k < 8, "510")
        .otherwise("000")
    )
    tail = F.when(k < 2, ".SH").when(k < 4, ".BJ").when(k < 8, ".SH").otherwise(".SZ")
    return daily.select(
        F.concat(head, F.lpad(k.cast("string"), 3, "0"), tail).alias("symbol"),
        F.when(k.between(4, 7), "etf").otherwise("stock").alias("asset_type"),
        "trade_date",
        price("first_seq").alias("open"),
        (F.col("high") / 100).alias("high"),
        (F.col("low") / 100).alias("low"),
        price("last_seq").alias("close"),
        (F.col("volume") / 100).alias("volume"),
        (F.col("amount") / 100).alias("amount"),
        F.lit("none").alias("adjustment"),
    )


def basic(spark: SparkSession, root: str) -> DataFrame:
    dropped = (F.col("volume") == 1) & F.col("symbol").startswith("000")
    return (
        bars(spark, root)
        .where((F.col("asset_type") == "stock") & ~dropped)
        .select("symbol", "trade_date", F.col("amount").alias("total_mv"))
    )


def calendar(spark: SparkSession, root: str) -> DataFrame:
    days = table(spark, root, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("cal_date")
    )
    return days.distinct().withColumn("is_open", F.lit(1))


def minute_bars(spark: SparkSession, root: str) -> DataFrame:
    """One-minute bars (bar-end time) inside the sessions, from ``events``."""
    minute = F.date_trunc("minute", "ts") + F.expr("INTERVAL 1 MINUTE")
    ticks = table(spark, root, "events").select(
        F.concat("event_type", F.lit(".SZ")).alias("symbol"),
        "ts",
        "value",
        minute.cast("timestamp_ntz").alias("bar_time"),
    )
    clock = F.hour("bar_time") * 60 + F.minute("bar_time")
    return (
        ticks.where(clock.between(571, 690) | clock.between(780, 900))
        .groupBy("symbol", "bar_time")
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            money("value").alias("amount"),
        )
        .select("symbol", F.col("bar_time").cast("date").alias("trade_date"), "bar_time",
                *BAR_VALUES)
    )


def nav(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("portfolio_id"),
            F.col("o_orderdate").cast("date").alias("trade_date"),
        )
        .agg(money("o_totalprice").alias("equity"))
    )


def holdings(spark: SparkSession, root: str) -> DataFrame:
    return (
        bars(spark, root)
        .where(F.col("symbol").startswith("000"))
        .groupBy(F.substring("symbol", 1, 6).alias("symbol"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def master(spark: SparkSession, root: str) -> DataFrame:
    last = F.when(F.col("symbol").startswith("430"), F.col("last_date"))
    return (
        bars(spark, root)
        .groupBy("symbol")
        .agg(F.min("trade_date").alias("list_date"), F.max("trade_date").alias("last_date"))
        .select("symbol", "list_date", last.alias("delist_date"))
    )


def adj_factor(spark: SparkSession, root: str) -> DataFrame:
    step = (F.year("trade_date") - 1995).cast("double") / 8
    return (
        bars(spark, root)
        .where(F.col("asset_type") == "etf")
        .select("symbol", "trade_date", (1.0 + step).alias("adj_factor"))
    )
