"""Set-based portfolio accounting: many weight portfolios at once, without an order loop.

A target takes effect on the first bar date after its signal. While the effective weights do not
change (an *epoch*) positions drift: equity(t) = E * (1 - sum w + sum w_i * mark_i(t) / fill_i),
with fill_i the first valid open of the epoch and mark the last observed close (or open). Epoch
start values chain over epochs through the open-valued drift and a first-order cost of trading.
Exact against a share ledger when nothing is blocked and costs are zero; epochs with a blocked
open are flagged.

Targets are sparse: ``targets`` (portfolio_id, signal_date, symbol, weight) holds non-zero rows,
``signals`` (portfolio_id, signal_date) every date with a say, so "all cash" is representable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from barloom.operators import panel as P
from barloom.session import cut

KEY = "portfolio_id"


@dataclass(frozen=True)
class Costs:
    initial_cash: float = 1_000_000.0
    commission_rate: float = 0.00025
    stamp_duty_rate: float = 0.0005
    slippage_rate: float = 0.0002


@dataclass(frozen=True)
class Accounts:
    epochs: DataFrame
    equity: DataFrame
    positions: DataFrame


def evaluation_targets(targets: DataFrame, signals: DataFrame,
                       start: str) -> tuple[DataFrame, DataFrame]:
    """Signals from ``start`` on, plus each portfolio's last one before it."""
    day = F.col("signal_date")
    begin = F.lit(start).cast("date")
    # ``min`` over dates >= start covers portfolios that only begin later.
    first = signals.groupBy(KEY).agg(
        F.coalesce(F.max(F.when(day < begin, day)), begin).alias("from_date")
    )

    def cut(frame: DataFrame) -> DataFrame:
        kept = frame.join(first, KEY).where(day >= F.col("from_date"))
        return kept.select(*frame.columns)

    return cut(targets), cut(signals)


def effective_signals(signals: DataFrame, axis: DataFrame) -> DataFrame:
    """Signal in force per execution date: the last one strictly before that bar date."""
    days = signals.select(F.col("signal_date").alias("trade_date")).distinct()
    marks = days.withColumn("date_idx", F.lit(None).cast("int")).union(
        axis.select("trade_date", "date_idx")
    ).groupBy("trade_date").agg(F.max("date_idx").alias("date_idx"))
    backwards = Window.orderBy(F.col("trade_date").desc())
    upcoming = F.last("date_idx", ignorenulls=True).over(
        backwards.rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per calendar day at most, so the mapping is broadcast.
    mapping = marks.select(F.col("trade_date").alias("signal_date"), upcoming.alias("start_idx"))
    return (
        signals.select(KEY, "signal_date").distinct()
        .join(F.broadcast(mapping), "signal_date").where(F.col("start_idx").isNotNull())
        .groupBy(KEY, "start_idx").agg(F.max("signal_date").alias("signal_date"))
        .withColumn("seq", F.row_number().over(Window.partitionBy(KEY).orderBy("start_idx")))
    )


def rebalances(targets: DataFrame, signals: DataFrame, axis: DataFrame) -> DataFrame:
    """Epoch table: one row each time the effective weights of a portfolio change.

    Weights are unchanged when both dates hold equally many symbols and every row repeats the
    previous date's weight: three counts instead of comparing collected vectors.
    """
    effective = effective_signals(signals, axis)
    held = targets.where(F.col("weight") != 0).join(effective, [KEY, "signal_date"])
    w = Window.partitionBy(KEY, "symbol").orderBy("seq")
    repeated = (F.lag("seq").over(w) == F.col("seq") - 1) & (
        F.lag("weight").over(w) == F.col("weight")
    )
    counts = held.withColumn("repeated", F.coalesce(repeated, F.lit(False))).groupBy(
        KEY, "seq"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if("repeated").alias("same"))
    joined = effective.join(counts, [KEY, "seq"], "left").na.fill(0, ["n", "same"])
    order = Window.partitionBy(KEY).orderBy("seq")
    changed = (
        (F.col("seq") == 1) | (F.col("n") != F.lag("n").over(order))
        | (F.col("same") != F.col("n"))
    )
    # The flag is computed before the filter: lag must see the unchanged dates too.
    turns = joined.withColumn("changed", changed).where("changed")
    end = axis.agg((F.max("date_idx") + 1).alias("size")).scalar()
    numbered = Window.partitionBy(KEY).orderBy("start_idx")
    return turns.select(
        KEY, F.row_number().over(numbered).alias("epoch"), "signal_date", "start_idx",
        F.coalesce(F.lead("start_idx").over(numbered), end).alias("next_idx"),
        F.lead("start_idx").over(numbered).isNotNull().alias("has_next"),
    )


def marks(bars: DataFrame, axis: DataFrame) -> DataFrame:
    """(symbol, date_idx): open of the day, mark, previous mark; gaps keep the last mark.

    Every bar speaks for the panel dates up to the symbol's next bar, so only real gaps expand.
    """
    w = P.series()
    rows = P.with_date_idx(bars.select("symbol", "trade_date", "open", "close"), axis)
    end = axis.agg(F.max("date_idx").alias("last")).scalar()
    filled = rows.withColumn("open", P.require_unique(F.col("open"), w)).select(
        "symbol", "date_idx", "open",
        P.forward_fill(F.coalesce("close", "open"), w).alias("mark"),
        F.coalesce(F.lead("date_idx").over(w) - 1, end).alias("until_idx"),
    ).withColumn("previous", F.lag("mark").over(w))
    dense = filled.select(
        "symbol", "open", "mark", "previous",
        F.posexplode(F.sequence("date_idx", "until_idx")).alias("nth", "date_idx"),
    )
    here = F.col("nth") == 0
    return dense.select(
        "symbol", "date_idx", F.when(here, F.col("open")).alias("open"), "mark",
        F.when(here, F.col("previous")).otherwise(F.col("mark")).alias("previous"),
    )


def next_valid_open(bars: DataFrame, axis: DataFrame, wanted: DataFrame) -> DataFrame:
    """(symbol, start_idx) -> first date on or after it with an open above zero."""
    opens = P.with_date_idx(bars.select("symbol", "trade_date", "open"), axis).select(
        "symbol", "date_idx",
        F.when(F.col("open") > 0, F.struct("date_idx", "open")).alias("fill"),
        F.lit(0).alias("asked"),
    ).join(wanted.select("symbol").distinct(), "symbol", "left_semi")
    asked = wanted.select(
        "symbol", F.col("start_idx").alias("date_idx"),
        F.lit(None).cast("struct<date_idx:int,open:double>").alias("fill"),
        F.lit(1).alias("asked"),
    ).distinct()
    merged = opens.union(asked).groupBy("symbol", "date_idx").agg(
        F.max("fill").alias("fill"), F.max("asked").alias("asked")
    )
    found = P.next_valid("fill", "symbol", include_current=True)
    return merged.withColumn("found", found).where(F.col("asked") == 1).select(
        "symbol", F.col("date_idx").alias("start_idx"),
        F.col("found.date_idx").alias("fill_idx"), F.col("found.open").alias("fill_open"),
    )


def epoch_holdings(bars: DataFrame, targets: DataFrame, epochs: DataFrame,
                   axis: DataFrame) -> DataFrame:
    """Holdings of every epoch with their fill; unfilled inside the epoch means null."""
    held = targets.where(F.col("weight") != 0).join(epochs, [KEY, "signal_date"])
    fills = next_valid_open(bars, axis, held.select("symbol", "start_idx"))
    inside = F.col("fill_idx") < F.col("next_idx")
    return held.join(fills, ["symbol", "start_idx"], "left").select(
        KEY, "epoch", "signal_date", "symbol", "weight", "start_idx", "next_idx", "has_next",
        F.when(inside, F.col("fill_idx")).alias("fill_idx"),
        F.when(inside, F.col("fill_open")).alias("fill_open"),
    )


def fill_table(bars: DataFrame, targets: DataFrame, signals: DataFrame,
               costs: Costs = Costs()) -> DataFrame:
    """Orders of every rebalance at their next valid open, slippage on the traded side.

    The side compares the new weight with the previous epoch's target weight.
    """
    axis = cut(P.date_axis(bars))
    epochs = cut(rebalances(targets, signals, axis))
    now = targets.where(F.col("weight") != 0).join(epochs, [KEY, "signal_date"]).select(
        KEY, "epoch", "symbol", F.col("weight").alias("new"), F.lit(0.0).alias("old")
    )
    before = targets.where(F.col("weight") != 0).join(epochs, [KEY, "signal_date"]).where(
        "has_next"
    ).select(KEY, (F.col("epoch") + 1).alias("epoch"), "symbol", F.lit(0.0).alias("new"),
             F.col("weight").alias("old"))
    orders = now.union(before).groupBy(KEY, "epoch", "symbol").agg(
        F.sum("new").alias("new"), F.sum("old").alias("old")
    ).where(F.col("new") != F.col("old"))
    placed = orders.join(epochs, [KEY, "epoch"])
    fills = next_valid_open(bars, axis, placed.select("symbol", "start_idx"))
    side = F.when(F.col("new") > F.col("old"), "BUY").otherwise("SELL")
    slip = F.when(F.col("new") > F.col("old"), 1 + costs.slippage_rate).otherwise(
        1 - costs.slippage_rate
    )
    inside = F.col("fill_idx") < F.col("next_idx")
    days = axis.select(F.col("date_idx").alias("fill_idx"),
                       F.col("trade_date").alias("fill_date"))
    return (
        placed.join(fills, ["symbol", "start_idx"], "left")
        .withColumn("fill_idx", F.when(inside, F.col("fill_idx")))
        .join(F.broadcast(days), "fill_idx", "left")
        .select(
            KEY, "signal_date", "symbol", side.alias("side"), "fill_date",
            F.when(inside, F.col("fill_open") * slip).alias("fill_price"),
            F.coalesce(F.col("fill_idx") != F.col("start_idx"), F.lit(True)).alias("delayed"),
        )
    )


def account(bars: DataFrame, targets: DataFrame, signals: DataFrame,
            costs: Costs = Costs()) -> Accounts:
    """Epochs, daily equity and daily drifted weights of every portfolio."""
    # The axis, the epochs and their holdings feed every later step: computed once.
    axis = cut(P.date_axis(bars))
    epochs = cut(rebalances(targets, signals, axis))
    holdings = cut(epoch_holdings(bars, targets, epochs, axis))
    prices = marks(bars, axis)

    # Open-valued drift at the end of each epoch, one row per holding.
    closing = holdings.where("has_next").join(
        prices.select("symbol", F.col("date_idx").alias("next_idx"), "open", "previous"),
        ["symbol", "next_idx"], "left",
    )
    filled = F.col("fill_idx").isNotNull()
    leaving = cut(closing.select(
        KEY, "epoch", "symbol", "weight", filled.alias("filled"),
        F.when(filled, F.coalesce("open", "previous") / F.col("fill_open")).otherwise(
            F.lit(1.0)).alias("growth"),
        (filled & ~F.coalesce(F.col("open") > 0, F.lit(False))).alias("stuck"),
    ))
    drift = epochs.join(
        leaving.groupBy(KEY, "epoch").agg(
            F.sum(F.col("weight") * (F.col("growth") - 1)).alias("gain"),
            F.count_if("stuck").alias("stuck"),
        ), [KEY, "epoch"], "left",
    ).select(
        KEY, "epoch", (1 + F.coalesce("gain", F.lit(0.0))).alias("drift"),
        F.coalesce("stuck", F.lit(0)).alias("stuck"),
    )
    # Weight changes at each epoch start: new targets against drifted old weights.
    old = leaving.where("filled").join(drift, [KEY, "epoch"]).select(
        KEY, (F.col("epoch") + 1).alias("epoch"), "symbol", F.lit(0.0).alias("new"),
        (F.col("weight") * F.col("growth") / F.col("drift")).alias("old"),
    )
    new = holdings.select(KEY, "epoch", "symbol", F.col("weight").alias("new"),
                          F.lit(0.0).alias("old"))
    moves = new.union(old).groupBy(KEY, "epoch", "symbol").agg(
        (F.sum("new") - F.sum("old")).alias("move")
    ).groupBy(KEY, "epoch").agg(
        F.sum(F.abs("move")).alias("turnover"),
        F.sum(F.greatest(-F.col("move"), F.lit(0.0))).alias("sold"),
    )
    delayed = holdings.groupBy(KEY, "epoch").agg(
        F.count_if(~F.col("fill_idx").eqNullSafe(F.col("start_idx"))).alias("delayed")
    )
    rate = costs.commission_rate + costs.slippage_rate
    order = Window.partitionBy(KEY).orderBy("epoch")
    ledger = cut(
        epochs.join(moves, [KEY, "epoch"], "left").join(delayed, [KEY, "epoch"], "left")
        .join(drift, [KEY, "epoch"], "left")
        .na.fill(0, ["turnover", "sold", "delayed"])
        .withColumn("cost", rate * F.col("turnover") + costs.stamp_duty_rate * F.col("sold"))
        .withColumns({
            "carried": F.coalesce(F.lag("drift").over(order), F.lit(1.0)),
            "stuck": F.coalesce(F.lag("stuck").over(order), F.lit(0)),
        })
        .withColumn("start_equity", costs.initial_cash * F.exp(
            F.sum(F.log(F.col("carried") * (1 - F.col("cost")))).over(order)
        ))
        .withColumn("blocked", (F.col("delayed") + F.col("stuck")) > 0)
        .select(KEY, "epoch", "signal_date", "start_idx", "next_idx", "turnover", "cost",
                "start_equity", "blocked")
    )

    daily = holdings.select(
        KEY, "epoch", "symbol", "weight", "fill_idx", "fill_open",
        F.explode(F.sequence("start_idx", F.col("next_idx") - 1)).alias("date_idx"),
    ).join(prices.select("symbol", "date_idx", "mark"), ["symbol", "date_idx"], "left")
    live = F.coalesce(F.col("date_idx") >= F.col("fill_idx"), F.lit(False))
    valued = daily.withColumns({
        "live": live,
        "value": F.when(live, F.col("weight") * F.coalesce("mark", F.lit(0.0))
                        / F.col("fill_open")).otherwise(F.col("weight")),
    })
    level = valued.groupBy(KEY, "epoch", "date_idx").agg(
        (1 + F.sum(F.col("value") - F.col("weight"))).alias("level")
    )
    # Dates of every epoch (cash-only epochs included) and the cash stretch before the first.
    spans = ledger.select(
        KEY, "epoch", "start_equity",
        F.explode(F.sequence("start_idx", F.col("next_idx") - 1)).alias("date_idx"),
    )
    head = ledger.where((F.col("epoch") == 1) & (F.col("start_idx") > 0)).select(
        KEY, F.lit(0).alias("epoch"), F.lit(costs.initial_cash).alias("start_equity"),
        F.explode(F.sequence(F.lit(0), F.col("start_idx") - 1)).alias("date_idx"),
    )
    days = F.broadcast(axis)
    equity = (
        spans.join(level, [KEY, "epoch", "date_idx"], "left").unionByName(
            head.withColumn("level", F.lit(1.0)))
        .join(days, "date_idx")
        .select(KEY, "trade_date",
                (F.col("start_equity") * F.coalesce("level", F.lit(1.0))).alias("equity"))
    )
    positions = (
        valued.where("live").join(level, [KEY, "epoch", "date_idx"]).join(days, "date_idx")
        .select(KEY, "trade_date", "symbol", (F.col("value") / F.col("level")).alias("weight"))
    )
    named = axis.select(F.col("date_idx").alias("start_idx"),
                        F.col("trade_date").alias("start_date"))
    table = ledger.join(F.broadcast(named), "start_idx").select(
        KEY, "epoch", "signal_date", "start_date", "turnover", "cost", "start_equity", "blocked"
    )
    return Accounts(table, equity, positions)
