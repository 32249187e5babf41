"""Rule-based strategies: bars in, long (symbol, trade_date, weight) frames out.

Only held rows are emitted; a date without rows is all cash. ``signal_dates`` gives the dates
on which a strategy had a say, so that "no holdings" stays distinguishable from "no signal".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from barloom.constants import CASH_SUMMARY, SUMMARY_SEPARATOR
from barloom.functions.normalize import code_excluded, fixed_text, log_bias
from barloom.operators import panel as P


def equal_weight(picks: DataFrame, by: list[str]) -> DataFrame:
    """1/n per group. Counts are aggregated map-side; ``by`` is a date, so they are few rows."""
    counts = picks.groupBy(*by).agg(F.count(F.lit(1)).alias("held"))
    return picks.join(F.broadcast(counts), by).select(
        *picks.columns, (1.0 / F.col("held")).alias("weight")
    )


# Trading days between rebalances -> calendar unit whose first date is a rebalance.
REBALANCE_UNITS = {1: "day", 5: "week_fri", **dict.fromkeys(range(20, 24), "month")}


def etf_indicators(bars: DataFrame, axis: DataFrame, windows: list[int], ma_window: int,
                   min_momentum: float) -> DataFrame:
    w = P.series()
    return (
        P.with_date_idx(bars.select("symbol", "trade_date", "close"), axis)
        .withColumn("close", P.require_unique(F.col("close"), w))
        .withColumns({
            "score": P.mean_return("close", windows, w),
            "ma": P.moving_average("close", ma_window, w),
        })
        .withColumn(
            "eligible",
            F.coalesce((F.col("score") > min_momentum) & (F.col("close") > F.col("ma")),
                       F.lit(False)),
        )
    )


def etf_rotation(
    bars: DataFrame,
    momentum_windows: tuple[int, ...] = (20, 60),
    ma_window: int = 28,
    min_momentum: float = 0.0,
    hold_num: int = 1,
    rebalance_days: int = 5,
) -> DataFrame:
    """Best ``hold_num`` by mean momentum above their moving average, kept until rebalance."""
    if rebalance_days not in REBALANCE_UNITS:
        raise ValueError(f"rebalance_days: {rebalance_days} is none of {sorted(REBALANCE_UNITS)}")
    axis = P.with_period_start(P.date_axis(bars), REBALANCE_UNITS[rebalance_days])
    scored = etf_indicators(bars, axis, list(momentum_windows), ma_window, min_momentum)
    candidates = scored.where(F.col("is_start") & F.col("eligible"))
    best = P.top_k(candidates, ["trade_date"], [F.col("score").desc(), F.col("symbol")],
                   max(1, hold_num))
    picks = equal_weight(best.select("symbol", "epoch"), ["epoch"])
    return P.carry_to_dates(picks, axis).select("symbol", "trade_date", "weight")


def log_bias_panel(bars: DataFrame, ema_window: int = 20,
                   axis: DataFrame | None = None) -> DataFrame:
    axis = P.date_axis(bars) if axis is None else axis
    frame = P.with_date_idx(bars.select("symbol", "trade_date", "close"), axis)
    smooth = P.with_ema(frame.select("symbol", "trade_date", "date_idx", "close"), "close",
                        ema_window)
    return smooth.withColumn("logbias", log_bias(F.col("close"), F.col("ema")))


def held_intervals(scored: DataFrame, enter: Column, leave: Column) -> DataFrame:
    """(symbol, first date_idx, last date_idx) stretches over which the latch is on.

    A symbol without a bar keeps its state, so each row speaks for the dates up to the next row.
    """
    w = P.series()
    end = F.coalesce(F.lead("date_idx").over(w) - 1, F.col("last_idx"))
    return scored.select(
        "symbol", F.col("date_idx").alias("first_idx"), end.alias("until_idx"),
        P.latch(enter, leave, w).alias("held"),
    ).where("held")


def logbias(bars: DataFrame, ema_window: int = 20, entry: float = 5.0, overheat: float = 15.0,
            stop: float = -5.0) -> DataFrame:
    """Hold from entry <= bias < overheat until bias <= stop; equal weight over the held set."""
    if not stop < entry < overheat:
        raise ValueError("stop < entry < overheat is required")
    axis = P.date_axis(bars)
    value = F.col("logbias")
    scored = log_bias_panel(bars, ema_window, axis).withColumn(
        "last_idx", axis.agg(F.max("date_idx").alias("last")).scalar()
    )
    held = held_intervals(scored, (value >= entry) & (value < overheat), value <= stop)
    days = held.select(
        "symbol", F.explode(F.sequence("first_idx", "until_idx")).alias("date_idx")
    ).join(F.broadcast(axis), "date_idx")
    return equal_weight(days.select("symbol", "trade_date"), ["trade_date"])


def microcap(
    bars: DataFrame,
    pool_size: int = 400,
    hold_count: int | None = None,
    selection: str = "pool",
    rank_start: int = 1,
    exclude_prefixes: tuple[str, ...] = ("688", "8", "4"),
    rebalance: str = "weekly",
    rps_lookback_days: int = 120,
    rps_target: float = 70.0,
) -> DataFrame:
    """Smallest stocks by the previous day's market cap (``bars`` carries ``total_mv``)."""
    units = {"daily": "day", "weekly": "week", "monthly": "month"}
    if selection not in ("pool", "rank", "rps", "smallest"):
        raise ValueError(f"unknown selection: {selection}")
    hold = pool_size if hold_count is None else hold_count
    axis = P.with_period_start(P.date_axis(bars), units[rebalance])
    rows = rebalance_caps(bars, axis, rps_lookback_days if selection == "rps" else 1)
    pool = smallest_pool(rows, exclude_prefixes, pool_size)
    if selection == "rank":
        first = max(1, rank_start)
        picked = pool.where(F.col("pool_rank").between(first, first + hold - 1))
    elif selection == "smallest":
        picked = pool.where(F.col("pool_rank") <= hold)
    elif selection == "rps":
        picked = closest_to_rps(pool, rps_lookback_days, rps_target, hold)
    else:
        picked = pool
    weights = equal_weight(picked.select("symbol", "epoch"), ["epoch"])
    return P.carry_to_dates(weights, axis).select("symbol", "trade_date", "weight")


def rebalance_caps(bars: DataFrame, axis: DataFrame, lookback: int) -> DataFrame:
    """Bars of the rebalance dates with the market cap of the date before and the close ``lookback`` dates before.

    Only rebalance dates and the dates they look back to enter the windows.
    """
    offsets = sorted({0, 1, lookback})
    touched = axis.where("is_start").select(
        F.explode(F.array(*[F.col("date_idx") - n for n in offsets])).alias("date_idx")
    ).distinct()
    w = P.series()
    rows = P.with_date_idx(bars.select("symbol", "trade_date", "close", "total_mv"), axis)
    return rows.join(F.broadcast(touched), "date_idx", "left_semi").withColumns({
        "previous_mv": P.lag_by(P.require_unique(F.col("total_mv"), w), 1, w),
        "base_close": P.lag_by("close", lookback, w),
    }).where("is_start")


def smallest_pool(rows: DataFrame, exclude_prefixes: tuple[str, ...], size: int) -> DataFrame:
    """The ``size`` smallest per date by the cap of the date before, with their ``pool_rank``."""
    candidates = rows.where(F.col("close").isNotNull() & F.col("previous_mv").isNotNull()
                            & ~code_excluded(F.col("symbol"), exclude_prefixes))
    return P.top_k(candidates, ["trade_date"], [F.col("previous_mv"), F.col("symbol")], size, "pool_rank")


def closest_to_rps(pool: DataFrame, lookback: int, target: float, hold: int) -> DataFrame:
    """The ``hold`` rows per date whose percent rank of growth within the pool is nearest to ``target``, as ``rank``."""
    ranked = (
        pool.where(F.col("date_idx") >= lookback)
        .withColumn("momentum", F.col("close") / F.col("base_close") - 1)
        .withColumn("rps", P.percent_rank("momentum", ["trade_date"]) * 100)
    )
    distance = F.abs(F.col("rps") - target)
    return P.top_k(ranked, ["trade_date"], [distance.asc_nulls_last(), F.col("pool_rank")], hold)


# ---- registry ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Strategy:
    """``build(bars, **params)`` returns (symbol, trade_date, weight); ``warmup(**params)`` the bars it needs before
    its first usable signal."""

    build: Callable[..., DataFrame]
    warmup: Callable[..., int]


# --- fixed values: bars of lead time ---
EMA_SPANS = 5  # of an exponential average until its start no longer matters
MICROCAP_LEAD = {"daily": 10, "weekly": 10, "monthly": 35}


def _rotation_warmup(momentum_windows=(20, 60), ma_window: int = 28, **_) -> int:
    return max(ma_window, *(1 + span for span in momentum_windows))


def _logbias_warmup(ema_window: int = 20, **_) -> int:
    return EMA_SPANS * ema_window


def _microcap_warmup(selection: str = "pool", rebalance: str = "weekly", rps_lookback_days: int = 120, **_) -> int:
    return rps_lookback_days + 2 if selection == "rps" else MICROCAP_LEAD[rebalance]


REGISTRY: dict[str, Strategy] = {
    "etf_rotation": Strategy(etf_rotation, _rotation_warmup),
    "logbias": Strategy(logbias, _logbias_warmup),
    "microcap": Strategy(microcap, _microcap_warmup),
}


def register_strategy(name: str, build: Callable[..., DataFrame], warmup: Callable[..., int] = lambda **_: 1) -> None:
    """Extension point for further strategies."""
    REGISTRY[name] = Strategy(build, warmup)


def _registered(name: str) -> Strategy:
    if name not in REGISTRY:
        raise KeyError(f"unknown strategy {name}; available: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def generate_targets(name: str, bars: DataFrame, **params: Any) -> DataFrame:
    return _registered(name).build(bars, **params)


def warmup_bars(name: str, **params: Any) -> int:
    """Observations a strategy needs before its first usable signal."""
    return _registered(name).warmup(**params)


def warmup_calendar_days(name: str, **params: Any) -> int:
    """Calendar days to load for them: two for every bar, and a month at least."""
    return max(2 * warmup_bars(name, **params), 30)


def signal_dates(bars: DataFrame) -> DataFrame:
    return bars.select("trade_date").distinct()


def latest_signal(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: as_of, number of holdings and the summary text of the last panel date."""
    as_of = bars.agg(F.max("trade_date").alias("as_of")).scalar()
    share = F.concat("symbol", F.lit(" "), fixed_text(F.col("weight") * 100, 1), F.lit("%"))
    entry = F.struct("symbol", share.alias("text"))
    held = weights.where(F.col("trade_date") == as_of).agg(
        F.count(F.lit(1)).alias("holdings"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    listed = F.array_join(F.transform("entries", lambda e: e["text"]), SUMMARY_SEPARATOR)
    return held.select(
        as_of.alias("as_of"), "holdings",
        F.when(F.col("holdings") == 0, F.lit(CASH_SUMMARY)).otherwise(listed).alias("summary"),
    )


def etf_diagnostics(bars: DataFrame, weights: DataFrame, momentum_windows=(20, 60),
                    ma_window: int = 28, min_momentum: float = 0.0) -> DataFrame:
    """Close, score, eligibility and target weight of every symbol on the last date."""
    as_of = bars.agg(F.max("trade_date").alias("as_of")).scalar()
    scored = etf_indicators(bars, P.date_axis(bars), list(momentum_windows), ma_window,
                            min_momentum)
    return (
        scored.where(F.col("trade_date") == as_of)
        .join(weights.where(F.col("trade_date") == as_of), ["symbol", "trade_date"], "left")
        .select("symbol", "close", F.col("score").alias("momentum_score"), "eligible",
                F.coalesce("weight", F.lit(0.0)).alias("target_weight"))
        .orderBy(F.col("momentum_score").desc_nulls_last(), "symbol")
    )


def log_bias_diagnostics(bars: DataFrame, weights: DataFrame, ema_window: int = 20) -> DataFrame:
    as_of = bars.agg(F.max("trade_date").alias("as_of")).scalar()
    scored = log_bias_panel(bars, ema_window).where(F.col("trade_date") == as_of)
    return (
        scored.join(weights.where(F.col("trade_date") == as_of), ["symbol", "trade_date"], "left")
        .select("symbol", "close", "logbias",
                F.coalesce("weight", F.lit(0.0)).alias("target_weight"))
        .orderBy(F.col("logbias").desc_nulls_last(), "symbol")
    )
