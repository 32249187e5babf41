"""As-of lookups on date axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest_before(days: DataFrame, events: DataFrame, strict: bool = False,
                  by: list[str] | None = None, day: str = "trade_date",
                  event: str = "signal_date") -> DataFrame:
    """Last event on or before (strictly: before) each day, per optional key.

    Both sides are stacked and the answer is a running maximum, so no inequality join is planned.
    With ``strict`` an event sorts after the days it shares its date with. Keys are date frames
    per entity; a key holds at most one row per date after the distinct.
    """
    keys = by or []
    asked = days.select(*keys, F.col(day).alias("at"), F.lit(None).cast("date").alias("seen"),
                        F.lit(1).alias("asked")).distinct()
    known = events.select(*keys, F.col(event).alias("at"), F.col(event).alias("seen"),
                          F.lit(0).alias("asked")).distinct()
    tie = F.col("asked").desc() if strict else F.col("asked").asc()
    running = Window.partitionBy(*keys).orderBy("at", tie).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        asked.union(known).withColumn("found", F.max("seen").over(running))
        .where((F.col("asked") == 1) & F.col("found").isNotNull())
        .select(*keys, F.col("at").alias(day), F.col("found").alias(event))
    )
