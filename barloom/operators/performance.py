"""Performance measures, period returns and trade statistics for many equity series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.constants import METRIC_LABELS, MISSING_CELL
from barloom.functions.normalize import number_text, percent_text, period_end
from barloom.operators.panel import require_unique

KEY = "portfolio_id"


def _steps(equity: DataFrame) -> DataFrame:
    """Equity with its one-step return and drawdown; one window over each series."""
    window = Window.partitionBy(KEY).orderBy("trade_date")
    peak = F.max("equity").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (
        equity.where(F.col("equity").isNotNull())
        .withColumn("equity", require_unique(F.col("equity"), window, "trade_date"))
        .withColumns({
            "ret": F.col("equity") / F.lag("equity").over(window) - 1,
            "drawdown": F.col("equity") / peak - 1,
        })
    )


def performance(equity: DataFrame, periods_per_year: int = 252,
                risk_free: float = 0.0) -> DataFrame:
    """total_return, cagr, annual_volatility, sharpe, max_drawdown, calmar per portfolio.

    Elapsed calendar time sets the growth rate; the number of observations per year (capped)
    annualises the volatility. Series with fewer than two points give no row.
    """
    facts = _steps(equity).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("equity", "trade_date").alias("first"),
        F.max_by("equity", "trade_date").alias("last"),
        F.datediff(F.max("trade_date"), F.min("trade_date")).alias("elapsed"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.min("drawdown").alias("max_drawdown"),
    ).where(F.col("points") >= 2)
    years = F.greatest(F.col("elapsed") / 365.25, F.lit(1 / 365.25))
    cap = F.lit(float(periods_per_year))
    annual = F.when(F.col("elapsed") > 0, F.least(cap, (F.col("points") - 1) / years)).otherwise(
        cap
    )
    growth = F.col("last") / F.col("first")
    rf_step = F.pow(F.lit(1 + risk_free), 1 / F.col("annual")) - 1
    return (
        facts.withColumns({"years": years, "annual": annual})
        .withColumns({
            "total_return": growth - 1,
            "cagr": F.pow(growth, 1 / F.col("years")) - 1,
            "annual_volatility": F.col("sd") * F.sqrt("annual"),
            "sharpe": F.when(
                F.col("sd") > 0, (F.col("mean") - rf_step) / F.col("sd") * F.sqrt("annual")
            ),
        })
        .withColumn("calmar", F.when(F.col("max_drawdown") < 0,
                                     F.col("cagr") / F.abs("max_drawdown")))
        .select(KEY, *METRIC_LABELS)
    )


def period_equity_returns(equity: DataFrame, unit: str) -> DataFrame:
    """Return of every calendar month or year; the first is relative to the first equity.

    Periods without a point inside a series are reported with a zero return.
    """
    last = equity.where(F.col("equity").isNotNull()).groupBy(
        KEY, period_end(F.col("trade_date"), unit).alias("period_end")
    ).agg(
        F.max_by("equity", "trade_date").alias("equity"),
        F.min_by("equity", "trade_date").alias("first_equity"),
    )
    window = Window.partitionBy(KEY).orderBy("period_end")
    base = F.coalesce(F.lag("equity").over(window), F.col("first_equity"))
    following = F.lead("period_end").over(window)
    # Empty periods up to the next observed one follow as zero returns.
    step = F.expr("INTERVAL 1 MONTH" if unit == "month" else "INTERVAL 1 YEAR")
    start = F.trunc("period_end", unit)
    stop = F.coalesce(F.trunc(following, unit), start + step)
    months = F.sequence(start, F.date_sub(stop.cast("date"), 1), step)
    return (
        last.withColumns({"ret": F.col("equity") / base - 1, "months": months})
        .select(KEY, "ret", F.posexplode("months").alias("nth", "month"))
        .select(
            KEY, period_end(F.col("month").cast("date"), unit).alias("period_end"),
            F.when(F.col("nth") == 0, F.col("ret")).otherwise(F.lit(0.0)).alias("ret"),
        )
    )


def monthly_stats(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy(KEY).agg(
        F.count_if(F.col("ret") > 0).alias("positive"),
        F.count_if(F.col("ret") < 0).alias("negative"),
        (F.count_if(F.col("ret") > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.avg("ret").alias("mean"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
    )


def trade_summary(trades: DataFrame, equity: DataFrame) -> DataFrame:
    """Orders, sides, costs and turnover (notional over mean equity) of every portfolio."""
    zero = F.lit(0.0)
    sums = trades.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("side") == "BUY").alias("buys"),
        F.count_if(F.col("side") == "SELL").alias("sells"),
        F.sum("notional").alias("notional"), F.sum("commission").alias("commission"),
        F.sum("tax").alias("tax"),
    )
    level = equity.groupBy(KEY).agg(F.avg("equity").alias("average"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "buys", "sells")]
    money = [F.coalesce(c, zero).alias(c) for c in ("notional", "commission", "tax")]
    turnover = F.when(F.col("average") != 0, F.coalesce("notional", zero) / F.col("average"))
    return level.join(sums, KEY, "left").select(
        KEY, *counts, *money,
        (F.coalesce("commission", zero) + F.coalesce("tax", zero)).alias("cost"),
        F.coalesce(turnover, zero).alias("turnover"),
    )


def aligned_benchmark(equity: DataFrame, benchmark: DataFrame,
                      initial_cash: float = 1_000_000.0) -> DataFrame:
    """Benchmark on each portfolio's dates, rebased; only where it covers all of them.

    ``benchmark`` is one index (trade_date, close). Portfolios with an uncovered date drop out
    here and show up in ``benchmark_gaps``.
    """
    closes = benchmark.groupBy("trade_date").agg(F.max("close").alias("close"))
    joined = equity.select(KEY, "trade_date").join(closes, "trade_date", "left")
    facts = joined.groupBy(KEY).agg(
        F.count_if(F.col("close").isNull()).alias("gaps"),
        F.min_by("close", "trade_date").alias("base"),
    ).where(F.col("gaps") == 0)
    return joined.join(facts, KEY).select(
        KEY, "trade_date", (F.col("close") / F.col("base") * initial_cash).alias("equity")
    )


def benchmark_gaps(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    lost = equity.select(KEY, "trade_date").join(
        benchmark.select("trade_date").distinct(), "trade_date", "left_anti"
    )
    return lost.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("missing_dates"), F.min("trade_date").alias("first_missing")
    )


def annual_comparison(equity: DataFrame, benchmark_equity: DataFrame) -> DataFrame:
    """Annual returns next to the benchmark's, with the excess."""
    own = period_equity_returns(equity, "year").withColumnRenamed("ret", "strategy_return")
    other = period_equity_returns(benchmark_equity, "year").withColumnRenamed(
        "ret", "benchmark_return"
    )
    return own.join(other, [KEY, "period_end"], "left").select(
        KEY, F.year("period_end").alias("year"), "strategy_return", "benchmark_return",
        (F.col("strategy_return") - F.col("benchmark_return")).alias("excess"),
    )


def _metric_text(name: str, value: Column) -> Column:
    share = name in ("total_return", "cagr", "annual_volatility", "max_drawdown")
    return percent_text(value, MISSING_CELL) if share else number_text(value, 2, MISSING_CELL)


def metric_table(metrics: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Display rows (portfolio, label, strategy text, benchmark text)."""
    other = metrics.select(KEY).limit(0) if benchmark is None else benchmark
    for name in METRIC_LABELS:
        value = F.lit(None).cast("double") if benchmark is None else F.col(name)
        other = other.withColumn(f"b_{name}", value)
    joined = metrics.join(other.select(KEY, *[f"b_{n}" for n in METRIC_LABELS]), KEY, "left")
    cells = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(label).alias("metric"),
            _metric_text(name, F.col(name)).alias("strategy"),
            _metric_text(name, F.col(f"b_{name}")).alias("benchmark"),
        )
        for i, (name, label) in enumerate(METRIC_LABELS.items())
    ]
    return joined.select(KEY, F.inline(F.array(*cells)))
