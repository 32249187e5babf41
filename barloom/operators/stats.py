"""Exact statistics that stay distributed, and the pairwise correlation of many series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.panel import panel_return, series, with_date_idx
from barloom.session import cut

# Digits of an ordered key, the leading one first: at most so many buckets of each are counted.
KEY_DIGITS = (20, 20, 24)


def ordered_key(value: str) -> Column:
    """A long that orders like the double and is equal for equal values: its IEEE magnitude with its sign."""
    x = F.col(value).cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(power > size, guess - 1).when(size >= 2 * power, guess + 1).otherwise(guess)
    unit = F.lit(1 << 52)
    normal = (exponent + 1023).cast("long") * unit + ((size / F.pow(F.lit(2.0), exponent) - 1) * unit).cast("long")
    tiny = (size / F.lit(5e-324)).cast("long")
    magnitude = (
        F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52))
        .when(size < F.lit(2.0 ** -1022), tiny).otherwise(normal)
    )
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def exact_median(frame: DataFrame, group: str, value: str) -> DataFrame:
    """Interpolated median per group, exact, without ordering a group.

    Radix selection: equal values are counted, then the counts of the leading digit of their key tell which bucket holds the
    middle rows, the next digit is counted inside that bucket only, and the last one gives the value. Whatever
    the values are, a bucket list is at most 2^24 long. ``group`` takes values from a short fixed list (the review
    periods), so what is looked for, two rows a group, is broadcast.
    """
    counted = (
        frame.select(group, value).where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(group, value).agg(F.count(F.lit(1)).alias("weight")).withColumn("key", ordered_key(value))
    )
    middle = F.col("n") + 1
    wanted = (
        counted.groupBy(group).agg(F.sum("weight").alias("n"))
        .select(group, F.posexplode(F.array(F.floor(middle / 2), F.ceil(middle / 2))).alias("side", "rank"),
                F.lit(0).cast("long").alias("prefix"))
    )
    below = sum(KEY_DIGITS)
    for digit in KEY_DIGITS:
        above, below = below, below - digit
        hit = F.lit(True) if above == sum(KEY_DIGITS) else F.shiftright("key", above) == F.col("prefix")
        found = (
            counted.withColumnRenamed(group, "_group").join(F.broadcast(wanted), F.col("_group").eqNullSafe(F.col(group)) & hit)
            .groupBy(group, "side", "rank", F.shiftright("key", below).alias("bucket")).agg(F.sum("weight").alias("inside"))
        )
        order = Window.partitionBy(group, "side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("upto", F.sum("inside").over(order)).where(F.col("upto") >= F.col("rank"))
        wanted = found.groupBy(group, "side").agg(
            F.min_by(F.struct((F.col("rank") - F.col("upto") + F.col("inside")).alias("rank"), F.col("bucket").alias("prefix")), "bucket")
            .alias("own")).select(group, "own.*", "side")
    values = counted.select(F.col(group).alias("_group"), "key", F.col(value).cast("double").alias("point"))
    return (
        values.join(F.broadcast(wanted), F.col("_group").eqNullSafe(F.col(group)) & (F.col("key") == F.col("prefix")))
        .groupBy(group).agg((F.min("point") / 2 + F.max("point") / 2).alias("half"), F.min("point").alias("least"), F.max("point").alias("most"))
        .select(group, F.when(F.abs("least") + F.abs("most") < float("inf"), (F.col("least") + F.col("most")) / 2)
                .otherwise(F.col("half")).alias("median"))
    )


def with_percent_rank(frame: DataFrame, by: str, value: str, out: str = "percent_rank") -> DataFrame:
    """Average-rank percentile of ``value`` within each group, for groups of any size.

    Equal values are counted before they are ordered. The counts are dealt to ranges of (group, value), as many as there are
    shuffle partitions; the totals of a group's ranges place them, and a window orders one range of one group. Where the
    borders fall changes no result. ``panel.percent_rank`` is the shorter form for groups of known small size.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, as the borders of ranges are drawn anew whenever they are computed.
    placed = cut(counts.repartitionByRange(ranges, by, value).withColumn("range", F.spark_partition_id()))
    totals = placed.groupBy(by, "range").agg(F.sum("ties").alias("inside"))
    whole = Window.partitionBy(by)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        by, "range", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"),
        F.sum("inside").over(whole).alias("total"),
    )
    local = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("below", F.coalesce(F.sum("ties").over(local), F.lit(0))).join(offsets, [by, "range"])
    average = F.col("offset") + F.col("below") + (F.col("ties") + 1) / 2
    shares = ranked.select(by, value, (average / F.col("total")).alias(out))
    return frame.join(shares, [by, value], "left").select(*frame.columns, out)


def return_correlation(
    bars: DataFrame, symbols: list[str] | DataFrame, block: int = 256, dates_per_task: int = 2048
) -> DataFrame:
    """Pairwise-complete correlation of one-step panel returns, as (symbol_a, symbol_b, corr).

    The result has a row for every pair of the named ``symbols`` (a list, or a frame of ``symbol``), so whoever asks sets its size.

    Series are cut into blocks. A task gets two blocks and one stretch of dates and reduces
    them to sufficient statistics with dense matrix products, so the shuffle carries each return
    once per block (not once per partner) and no join ever pairs rows of the same date. Partial
    sums are added up per pair. Values are centred per symbol first to keep the sums accurate.
    """
    if isinstance(symbols, DataFrame):
        bars = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    else:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    window = series()
    returns = (
        with_date_idx(bars.select("symbol", "trade_date", "close"))
        .withColumn("ret", panel_return("close", 1, window))
        .where(F.col("ret").isNotNull())
        .withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("symbol")))
        .withColumn("stretch", F.floor(F.col("date_idx") / dates_per_task))
    )
    # A block number per series: hashing keeps blocks near ``block`` series on average; the
    # number of blocks comes from the distinct count of series.
    universe = returns.agg(F.count_distinct("symbol").alias("n"))
    blocks = F.greatest(F.ceil(universe.scalar() / block), F.lit(1)).cast("int")
    placed = returns.select(
        "symbol", "date_idx", "stretch", "x",
        F.pmod(F.xxhash64("symbol"), blocks).cast("int").alias("block"),
        blocks.alias("blocks"),
    )
    # Each row goes to every block pair it takes part in: (own, other) with own <= other as the
    # left side, (other, own) as the right side. The fan-out is the number of blocks.
    partners = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    routed = placed.withColumn("other", partners).select(
        "symbol", "date_idx", "stretch", "x",
        F.least("block", "other").alias("left_block"),
        F.greatest("block", "other").alias("right_block"),
        (F.col("block") <= F.col("other")).alias("is_left"),
        (F.col("block") >= F.col("other")).alias("is_right"),
    )

    def reduce_pair(part: pd.DataFrame) -> pd.DataFrame:
        days = np.unique(part["date_idx"].to_numpy())

        def matrix(side: str):
            rows = part[part[side]]
            names, column = np.unique(rows["symbol"].to_numpy(dtype=object), return_inverse=True)
            dense = np.zeros((len(days), len(names)))
            seen = np.zeros((len(days), len(names)))
            line = np.searchsorted(days, rows["date_idx"].to_numpy())
            dense[line, column] = rows["x"].to_numpy()
            seen[line, column] = 1.0
            return names, dense, seen

        left, a, has_a = matrix("is_left")
        right, b, has_b = matrix("is_right")
        count = has_a.T @ has_b
        wanted = count > 0
        if part["left_block"].iat[0] == part["right_block"].iat[0]:
            wanted &= left[:, None] <= right[None, :]
        i, j = np.nonzero(wanted)
        return pd.DataFrame(
            {
                "symbol_a": left[i],
                "symbol_b": right[j],
                "n": count[i, j],
                "sa": (a.T @ has_b)[i, j],
                "sb": (has_a.T @ b)[i, j],
                "saa": ((a * a).T @ has_b)[i, j],
                "sbb": (has_a.T @ (b * b))[i, j],
                "sab": (a.T @ b)[i, j],
            }
        )

    partial = routed.groupBy("left_block", "right_block", "stretch").applyInPandas(
        reduce_pair,
        "symbol_a string, symbol_b string, n double, sa double, sb double, "
        "saa double, sbb double, sab double",
    )
    swapped = F.col("symbol_a") > F.col("symbol_b")
    pair = partial.select(
        F.least("symbol_a", "symbol_b").alias("symbol_a"),
        F.greatest("symbol_a", "symbol_b").alias("symbol_b"),
        "n", "sab",
        F.when(swapped, F.col("sb")).otherwise(F.col("sa")).alias("sa"),
        F.when(swapped, F.col("sa")).otherwise(F.col("sb")).alias("sb"),
        F.when(swapped, F.col("sbb")).otherwise(F.col("saa")).alias("saa"),
        F.when(swapped, F.col("saa")).otherwise(F.col("sbb")).alias("sbb"),
    )
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")
    total = pair.groupBy("symbol_a", "symbol_b").agg(*[F.sum(c).alias(c) for c in sums])
    covariance = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    spread_a = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    spread_b = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    scale = F.sqrt(spread_a) * F.sqrt(spread_b)
    return total.select(
        "symbol_a", "symbol_b",
        F.when((F.col("n") > 1) & (scale > 0), covariance / scale).alias("corr"),
    )
