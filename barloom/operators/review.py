"""Market review: period returns on shared anchors, breadth, summaries, review matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.constants import (
    BREADTH_BUCKETS,
    DAY,
    MONTH,
    PERIODS,
    REVIEW_AVERAGE_ROWS,
    REVIEW_CONVERTIBLE_ROWS,
    REVIEW_COUNT_ROWS,
    REVIEW_RATIO_ROWS,
    REVIEW_TAIL_ROWS,
    REVIEW_UNDERLYING_ROWS,
    WEEK,
    YEAR,
)
from barloom.functions.normalize import (
    count_text,
    denoise,
    finite,
    percent_text,
    stock_symbol,
    to_number,
)
from barloom.operators.panel import bias, keep_newest, series, with_date_idx
from barloom.operators.stats import exact_median

_START_OF = {WEEK: "week", MONTH: "month", YEAR: "year"}


def review_anchors(dates: DataFrame, as_of=None) -> DataFrame:
    """One row: the review date and the base date of each period, all on the bar-date axis.

    A base is the last date before the review day / its week / month / year. Only maxima are
    taken, so the scan reads one column and ships one row per task.
    """
    day = F.col("trade_date")
    known = dates.select("trade_date")
    upto = known if as_of is None else known.where(day <= F.lit(str(as_of)).cast("date"))
    latest = upto.agg(F.max("trade_date").alias("latest")).scalar()
    bases = [
        F.max(F.when(day < (latest if period == DAY else F.trunc(latest, _START_OF[period])),
                     day)).alias(period)
        for period in PERIODS
    ]
    found = known.agg(F.max(F.when(day <= latest, day)).alias("latest"), *bases)
    return found.select(*[_required(name).alias(name) for name in ("latest", *PERIODS)])


def anchor_values(anchors: DataFrame) -> dict[str, Column]:
    """Anchor dates as expressions over one scalar subquery."""
    names = ("latest", *PERIODS)
    row = anchors.select(F.struct(*names).alias("anchors")).scalar()
    return {name: row[name] for name in names}


def _required(name: str) -> Column:
    message = F.lit(f"no bars on or before the {name} anchor")
    return F.when(F.col(name).isNull(), F.raise_error(message).cast("date")).otherwise(
        F.col(name)
    )


def period_returns(bars: DataFrame, as_of=None, anchors: DataFrame | None = None) -> DataFrame:
    """(symbol, return per period). Only the anchor dates are scanned."""
    anchors = review_anchors(bars, as_of) if anchors is None else anchors
    at = anchor_values(anchors)
    needed = reduce(lambda a, b: a | b, [F.col("trade_date") == at[n] for n in at])
    prices = (
        bars.select("symbol", "trade_date", finite(F.col("close")).alias("close"))
        .where(needed)
        .groupBy("symbol")
        .agg(*[F.max(F.when(F.col("trade_date") == at[n], F.col("close"))).alias(n) for n in at])
    )
    return prices.select(
        "symbol", *[(F.col("latest") / F.col(p) - 1).alias(p) for p in PERIODS]
    )


def by_period(returns: DataFrame) -> DataFrame:
    return returns.unpivot("symbol", list(PERIODS), "period", "ret")


def _in_bucket(value: Column, lower, upper) -> Column:
    above = F.lit(True) if lower is None else value > lower
    below = F.lit(True) if upper is None else value <= upper
    return value.isNotNull() & above & below


def breadth(returns: DataFrame) -> DataFrame:
    """Counts per return bucket (rows) and period (columns); one aggregate pass."""
    cells = [
        F.count_if(_in_bucket(denoise(F.col(period)), lower, upper)).alias(f"b{i}_{j}")
        for i, (_, lower, upper) in enumerate(BREADTH_BUCKETS)
        for j, period in enumerate(PERIODS)
    ]
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(label).alias("区间"),
            *[F.col(f"b{i}_{j}").alias(period) for j, period in enumerate(PERIODS)],
        )
        for i, (label, _, _) in enumerate(BREADTH_BUCKETS)
    ]
    return returns.agg(*cells).select(F.inline(F.array(*rows)))


def day_summary(returns: DataFrame, anchors: DataFrame) -> DataFrame:
    day = F.col(DAY)
    counts = returns.agg(
        F.count(day).alias("stocks"),
        F.count_if(day > 0).alias("up"),
        F.count_if(day < 0).alias("down"),
        F.count_if(day == 0).alias("flat"),
        F.avg(day).alias("mean_return"),
    )
    middle = exact_median(returns.withColumn("period", F.lit(DAY)), "period", DAY)
    return counts.select(
        anchors.select("latest").scalar().cast("string").alias("as_of"),
        "stocks", "up", "down", "flat",
        middle.select("median").scalar().alias("median_return"),
        "mean_return",
    )


def return_summary(returns: DataFrame) -> DataFrame:
    """Mean, median and count of the returns of each period."""
    long = by_period(returns)
    counts = long.groupBy("period").agg(
        F.avg("ret").alias("mean"), F.count("ret").alias("count")
    )
    middle = exact_median(long, "period", "ret")
    return counts.join(middle, "period", "left").select("period", "mean", "median", "count")


def coerced_holdings(holdings: DataFrame) -> DataFrame:
    """(symbol, weight) with full symbols and numbers; what is no number weighs nothing."""
    return holdings.select(
        stock_symbol(F.col("symbol")).alias("symbol"),
        F.coalesce(to_number(F.col("weight")), F.lit(0.0)).alias("weight"),
    )


def scaled_weights(holdings: DataFrame) -> DataFrame:
    """(symbol, weight) with weights that sum to one."""
    held = coerced_holdings(holdings)
    return held.withColumn("weight", F.col("weight") / held.agg(F.sum("weight").alias("total")).scalar())


def portfolio_period_returns(returns: DataFrame, holdings: DataFrame) -> DataFrame:
    """Weighted period returns of a holdings list; fails on missing symbols or anchor prices.

    ``holdings`` has (symbol, weight): weights are coerced, rescaled to one, and every holding
    must have a price on every anchor.
    """
    held = coerced_holdings(holdings)
    total = held.agg(F.sum("weight").alias("total")).scalar()
    joined = held.join(returns.withColumn("priced", F.lit(True)), "symbol", "left")
    unpriced = F.count_if(F.col("priced").isNull())
    gap = [F.count_if(F.col("priced") & F.col(p).isNull()) for p in PERIODS]
    weighted = [F.sum(F.col("weight") * F.col(p) / total).alias(p) for p in PERIODS]
    sums = joined.agg(
        unpriced.alias("unpriced"), *[g.alias(f"gap{i}") for i, g in enumerate(gap)],
        total.alias("total"), *weighted,
    )
    gaps = sum((F.col(f"gap{i}") for i in range(1, len(PERIODS))), F.col("gap0"))
    problem = (
        F.when(F.col("unpriced") > 0, F.lit("holdings without review bars"))
        .when(F.coalesce(F.col("total"), F.lit(0.0)) <= 0, F.lit("holding weights must be > 0"))
        .when(gaps > 0, F.lit("holdings lack a price on an anchor date"))
    )
    checked = [
        F.when(problem.isNotNull(), F.raise_error(problem).cast("double"))
        .otherwise(F.col(p)).alias(p)
        for p in PERIODS
    ]
    return sums.select(*checked)


def holding_gaps(returns: DataFrame, holdings: DataFrame) -> DataFrame:
    """Why a portfolio return would be refused: one row per (symbol, period) without a price."""
    held = holdings.select(stock_symbol(F.col("symbol")).alias("symbol")).distinct()
    return by_period(
        held.join(returns, "symbol", "left")
    ).where(F.col("ret").isNull()).select("symbol", "period")


def price_bias(bars: DataFrame, span: int = 25, as_of=None) -> DataFrame:
    """Close over its moving average, minus one, for every symbol on the review date."""
    axis_end = bars if as_of is None else bars.where(
        F.col("trade_date") <= F.lit(str(as_of)).cast("date")
    )
    # Only the last ``span`` panel dates matter; the bound reaches the scan as a date filter.
    window_dates = (
        axis_end.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(span)
    )
    ends = window_dates.agg(F.struct(F.min("trade_date").alias("first"),
                                     F.max("trade_date").alias("latest")).alias("ends")).scalar()
    recent = axis_end.select("symbol", "trade_date", "close").where(
        F.col("trade_date") >= ends["first"])
    return (
        with_date_idx(recent).withColumn("bias", bias("close", span, series()))
        .where(F.col("trade_date") == ends["latest"])
        .select("symbol", "trade_date", "bias")
    )


def clean_nav(nav: DataFrame) -> DataFrame:
    """Numeric, positive NAV with the last entry kept per date; fails on values <= 0."""
    usable = nav.select(
        "portfolio_id", "trade_date", to_number(F.col("equity")).alias("equity"),
        *[c for c in nav.columns if c not in ("portfolio_id", "trade_date", "equity")],
    ).where(F.col("equity").isNotNull())
    if "seq" in usable.columns:
        usable = keep_newest(usable, ["portfolio_id", "trade_date"], ["seq"])
    bad = F.raise_error(F.lit("NAV must be positive")).cast("double")
    return usable.withColumn(
        "equity", F.when(F.col("equity") <= 0, bad).otherwise(F.col("equity"))
    )


def nav_period_returns(nav: DataFrame, anchors: DataFrame) -> DataFrame:
    """Review-period returns per portfolio; anchors are resolved on the portfolio's own dates.

    Each lookup "value on the last date <= anchor" is a max-by aggregate, so all anchors of all
    portfolios come out of one partially aggregated pass.
    """
    at = anchor_values(anchors)
    day = F.col("trade_date")
    picked = clean_nav(nav).groupBy("portfolio_id").agg(
        *[F.max_by(F.when(day <= at[n], F.col("equity")), F.when(day <= at[n], day)).alias(n)
          for n in at]
    )
    return picked.select(
        "portfolio_id", *[(F.col("latest") / F.col(p) - 1).alias(p) for p in PERIODS]
    )


def named_returns(returns: DataFrame, names: dict[str, str],
                  biases: DataFrame | None = None) -> DataFrame:
    """Returns of configured (name -> symbol) entries in their order; absent ones stay blank."""
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("name"),
                        F.lit(symbol).alias("symbol"))
               for i, (name, symbol) in enumerate(names.items())]
    listed = returns.sparkSession.range(1).select(F.inline(F.array(*entries)))
    out = listed.join(returns, "symbol", "left")
    if biases is None:
        return out.withColumn("bias", F.lit(None).cast("double"))
    return out.join(biases.select("symbol", "bias"), "symbol", "left")


def log_bias_table(frame: DataFrame, days: int = 10) -> DataFrame:
    """Last ``days`` panel dates of an indicator: rows (symbol, days_back, bias)."""
    last = frame.agg(F.max("date_idx").alias("last")).scalar()
    return frame.where(F.col("date_idx") > last - days).select(
        "symbol", "trade_date", (last - F.col("date_idx")).alias("days_back"), "logbias"
    )


def _rows(frame: DataFrame, cells: list[tuple[int, str, Column]]) -> DataFrame:
    """Per-period frame -> (period, ordinal, 名称, text) rows, several measures in one pass."""
    entries = [
        F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("名称"), text.alias("text"))
        for ordinal, name, text in cells
    ]
    return frame.select("period", F.inline(F.array(*entries)))


def _wide_rows(frame: DataFrame, start: int, name: Column) -> DataFrame:
    """Frame with one row and a column per period -> review rows."""
    cells = [
        F.struct(F.lit(p).alias("period"), percent_text(F.col(p)).alias("text")) for p in PERIODS
    ]
    return frame.select(
        F.lit(start).alias("ordinal"), name.alias("名称"), F.inline(F.array(*cells))
    ).select("period", "ordinal", "名称", "text")


def daily_review_table(
    returns: DataFrame,
    index_returns: DataFrame | None = None,
    convertible: DataFrame | None = None,
    underlying: DataFrame | None = None,
    microcap: DataFrame | None = None,
    portfolio: DataFrame | None = None,
) -> DataFrame:
    """Display matrix: one row per measure, one text column per period plus BIAS25.

    ``index_returns`` carries (ordinal, name, periods..., bias); ``convertible`` and
    ``underlying`` are ``return_summary`` frames; ``microcap`` and ``portfolio`` have one row
    with a column per period. Absent inputs leave blank cells.
    """
    long = by_period(returns)
    rounded = denoise(F.col("ret"))
    shares = [F.count_if(_in_bucket(rounded, low, high)).alias(f"b{i}")
              for i, (_, low, high) in enumerate(BREADTH_BUCKETS)]
    stats = (
        long.groupBy("period")
        .agg(
            F.count("ret").alias("n"),
            F.count_if(F.col("ret") > 0).alias("up"),
            F.count_if(F.col("ret") < 0).alias("down"),
            F.count_if(F.col("ret") == 0).alias("flat"),
            F.avg("ret").alias("mean"),
            *shares,
        )
        .join(exact_median(long, "period", "ret"), "period", "left")
    )

    def share(count: str) -> Column:
        return percent_text(F.when(F.col("n") > 0, F.col(count) / F.col("n")))

    measures = [(name, count_text(F.col(c)))
                for name, c in zip(REVIEW_COUNT_ROWS, ("n", "up", "down", "flat"), strict=True)]
    measures += [(bucket[0], share(f"b{i}")) for i, bucket in enumerate(BREADTH_BUCKETS)]
    measures += [(name, share(c))
                 for name, c in zip(REVIEW_RATIO_ROWS, ("up", "down"), strict=True)]
    measures += [(name, percent_text(F.col(c)))
                 for name, c in zip(REVIEW_AVERAGE_ROWS, ("mean", "median"), strict=True)]
    parts = [_rows(stats, [(i, name, text) for i, (name, text) in enumerate(measures)])]
    position = len(measures)
    # The tail is a section of its own, behind any number of indices.
    indices, tail = position + 4, 1 << 62
    mean, median = percent_text(F.col("mean")), percent_text(F.col("median"))
    blanks: list[tuple[int, str]] = []
    rows = [(position, REVIEW_CONVERTIBLE_ROWS[0], mean),
            (position + 1, REVIEW_CONVERTIBLE_ROWS[1], median),
            (tail + 1, REVIEW_TAIL_ROWS[1], mean)]
    under = [(position + 2, REVIEW_UNDERLYING_ROWS[0], mean),
             (position + 3, REVIEW_UNDERLYING_ROWS[1], median)]
    for summary, cells in ((convertible, rows), (underlying, under)):
        if summary is None:
            blanks += [(ordinal, name) for ordinal, name, _ in cells]
        else:
            parts.append(_rows(summary, cells))
    if index_returns is not None:
        cell = [F.struct(F.lit(p).alias("period"), percent_text(F.col(p)).alias("text"))
                for p in PERIODS]
        cell.append(F.struct(F.lit("BIAS25").alias("period"),
                             percent_text(F.col("bias")).alias("text")))
        parts.append(
            index_returns.select(
                (F.lit(indices) + F.col("ordinal")).cast("bigint").alias("ordinal"),
                F.col("name").alias("名称"), F.inline(F.array(*cell)),
            ).select("period", "ordinal", "名称", "text")
        )
    for ordinal, name, frame in ((tail, REVIEW_TAIL_ROWS[0], microcap),
                                 (tail + 2, REVIEW_TAIL_ROWS[2], portfolio)):
        if frame is None:
            blanks.append((ordinal, name))
        else:
            parts.append(_wide_rows(frame, ordinal, F.lit(name)))
    if blanks:
        periods = returns.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(p) for p in PERIODS])).alias("period"))
        parts.append(_rows(periods, [(o, name, F.lit("")) for o, name in blanks]))
    stacked = reduce(DataFrame.unionByName, parts)
    columns = [*PERIODS, "BIAS25"]
    wide = stacked.groupBy("ordinal", "名称").pivot("period", columns).agg(F.max("text"))
    order = Window.orderBy("ordinal")  # the finished table: 21 rows plus the indices
    return wide.fillna("", columns).select(
        F.row_number().over(order).alias("row"), "名称", *columns
    )
