"""Session-aware minute-bar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.constants import BAR_VALUES, MINUTE_FREQUENCIES
from barloom.functions.normalize import frequency_minutes


def resample(minutes: DataFrame, frequency: str) -> DataFrame:
    """1-minute bars -> 5/15/30/60-minute bars within each session, labelled at bucket end.

    Buckets count from the session open (09:30 or 13:00); a 13:00 reopening bar joins the first
    afternoon bucket, and auctions pass through. One aggregate keyed by the target bar; first and
    last prices are min-by/max-by on time over non-null values, so everything combines map-side.
    """
    if frequency not in MINUTE_FREQUENCIES[1:]:
        raise ValueError(f"frequency must be one of {MINUTE_FREQUENCIES[1:]}")
    step = frequency_minutes(frequency)
    rows = minutes if "is_auction" in minutes.columns else minutes.withColumn(
        "is_auction", F.lit(False)
    )
    time = F.col("bar_time")
    seconds = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    opens = F.when(F.hour(time) < 12, 34200).otherwise(46800)
    elapsed = F.greatest((seconds - opens) / 60, F.lit(1))
    bucket = F.floor((elapsed + step - 1) / step) * step
    target = F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(
        secs=opens + bucket * 60
    )
    regular = (
        rows.where(~F.col("is_auction"))
        .withColumns({"target_time": target, "morning": F.hour(time) < 12})
        .groupBy("symbol", "trade_date", "morning", "target_time")
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), time)).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), time)).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
            F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"),
        )
        .dropna(subset=["open", "close"])
    )
    columns = ["symbol", "trade_date", "bar_time", *BAR_VALUES]
    bars = regular.withColumnRenamed("target_time", "bar_time").select(
        *columns, F.lit(frequency).alias("frequency"), F.lit(False).alias("is_auction")
    )
    auctions = rows.where("is_auction").select(
        *columns, F.lit(frequency).alias("frequency"), "is_auction"
    )
    return bars.union(auctions)


def catalog(minutes: DataFrame) -> DataFrame:
    """One row per stored (symbol, year) slice, derived from the data."""
    return minutes.groupBy("symbol", F.year("bar_time").alias("year"), "asset_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("bar_time").alias("min_time"), F.max("bar_time").alias("max_time"),
    )


def coverage(minutes: DataFrame) -> DataFrame:
    """Symbols, (symbol, year) slices, rows and time range per asset type."""
    return catalog(minutes).groupBy("asset_type").agg(
        F.count_distinct("symbol").alias("symbols"),
        F.count(F.lit(1)).alias("partitions"),
        F.sum("rows").alias("rows"),
        F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"),
    )
