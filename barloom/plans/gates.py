"""Gates evaluated before a signal is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def signal_gate(bars: DataFrame, universe: DataFrame, required: int, as_of: Column | None = None) -> DataFrame:
    """Per configured symbol: history up to the requested date, a bar on that date, and enough warm-up.

    ``as_of`` is the date that was asked for; without it the last date of the bars. With a store that ends before the
    requested date no symbol is fresh.
    """
    target = bars.agg(F.max("trade_date").alias("latest")).scalar() if as_of is None else as_of
    counts = bars.where(F.col("trade_date") <= target).groupBy("symbol").agg(
        F.count_distinct("trade_date").alias("dates"), F.max("trade_date").alias("last_date")
    )
    joined = universe.select("symbol").distinct().join(counts, "symbol", "left")
    return joined.select(
        "symbol", F.coalesce("dates", F.lit(0)).alias("dates"),
        F.coalesce(F.col("last_date") == target, F.lit(False)).alias("fresh"),
        (F.coalesce("dates", F.lit(0)) >= required).alias("warm"),
    )


def dated_weights(weights: DataFrame, as_of: Column) -> DataFrame:
    """Weights of a signal of the requested date; a signal of any other date gives none."""
    return weights.where(F.col("trade_date") == as_of)
