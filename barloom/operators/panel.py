"""Panel semantics on long frames.

Offsets step over the *shared* trading-date axis, not over a symbol's own rows. ``date_idx`` is
the position of a date on that axis, and lags/rolling windows are RANGE frames over it, so one
shuffle by series key serves every lag and average of a series. A (series, date) key is unique
(``require_unique`` fails otherwise), which bounds each series by the length of the date axis:
no window partition can grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.normalize import period_key
from barloom.session import cut


def date_axis(frame: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct dates with their position. At most one row per calendar day of the DATE type."""
    days = frame.select(F.col(date).cast("date").alias(date)).where(F.col(date).isNotNull())
    # The only unpartitioned window in the library: it runs on distinct dates, after the
    # distinct has collapsed the rows map-side.
    order = Window.orderBy(date)
    return days.distinct().select(date, (F.row_number().over(order) - 1).alias("date_idx"))


def with_date_idx(frame: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Attach ``date_idx``. The axis is bounded by the calendar, so it is safe to broadcast."""
    axis = date_axis(frame) if axis is None else axis
    return frame.join(F.broadcast(axis), "trade_date")


def series(key: str | list[str] = "symbol", order: str = "date_idx") -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def require_unique(value: Column, window: WindowSpec, order: str = "date_idx") -> Column:
    """Pass ``value`` through, failing when a series holds the same date twice."""
    repeated = F.lag(order).over(window) == F.col(order)
    return F.when(
        repeated, F.raise_error(F.lit("duplicate date in a series")).cast("double")
    ).otherwise(value)


def lag_by(value: str | Column, steps: int, window: WindowSpec) -> Column:
    """Value exactly ``steps`` panel dates back; null when the series has no row there."""
    return F.max(value).over(window.rangeBetween(-steps, -steps))


def ratio(value: Column, base: Column) -> Column:
    """Division of doubles as IEEE defines it: over zero an infinity with the sign of ``value``, or NaN, never an error."""
    return F.when(base == 0, value * F.lit(float("inf"))).otherwise(F.try_divide(value, base))


def panel_return(value: str, steps: int, window: WindowSpec) -> Column:
    return ratio(F.col(value), lag_by(value, steps, window)) - 1


def mean_return(value: str, spans: list[int], window: WindowSpec) -> Column:
    """Average of several n-step returns; null as soon as one of them is null."""
    total = sum((panel_return(value, span, window) for span in spans[1:]),
                panel_return(value, spans[0], window))
    return total / len(spans)


def moving_average(value: str, span: int, window: WindowSpec) -> Column:
    """Simple average over ``span`` panel dates, all of which must be observed."""
    frame = window.rangeBetween(-(span - 1), 0)
    return F.when(F.count(value).over(frame) == span, F.avg(value).over(frame))


def bias(value: str, span: int, window: WindowSpec) -> Column:
    return ratio(F.col(value), moving_average(value, span, window)) - 1


# Weights below exp(-REACH) of the newest one, far less than a double can hold beside it, may be left out.
REACH = 150.0
EMA_BLOCK = 64  # positions of the axis in a block


def affine_scan(frame: DataFrame, keys: list[str], order: str, log_factor: str, term: str) -> DataFrame:
    """Run ``level = factor * level + term`` along each series, from 0, as prefix sums.

    Adds ``_log``, the logarithm of the product of the factors so far, and ``_level``. A sum of terms divided by that
    product would overflow, so rows are cut into bins inside which the product falls by at most ``exp(-2 * REACH)``;
    sums run inside a bin, and a bin takes over the level of the two before it. Factors must lie in (0, 1] and logarithms
    must not be under -REACH.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    running = along.rowsBetween(Window.unboundedPreceding, 0)
    # Bins rise with the order, so sorting by both serves the windows over bins and over series.
    in_bin = Window.partitionBy(*keys, "_bin").orderBy(order)
    by_bin = Window.partitionBy(*keys).orderBy("_bin", order)
    so_far = by_bin.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("_log") - F.col("_base")
    return (
        frame.withColumn("_log", F.sum(log_factor).over(running))
        .withColumn("_bin", F.floor(-F.col("_log") / REACH))
        .withColumns({"_base": F.first(F.col("_log") - F.col(log_factor)).over(in_bin),
                      "_opens": F.row_number().over(in_bin) == 1})
        .withColumn("_own", F.exp(inside) * F.sum(F.col(term) * F.exp(-inside)).over(
            in_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"_before": F.coalesce(F.lag("_own").over(by_bin), F.lit(0.0)),
                      "_kept": F.coalesce(F.lag(F.exp(inside)).over(by_bin), F.lit(0.0))})
        .withColumn("_one", F.last(F.when(F.col("_opens"), F.col("_before")), ignorenulls=True).over(so_far))
        .withColumn("_two", F.coalesce(F.lag("_one").over(by_bin), F.lit(0.0)))
        .withColumn("_start", F.last(F.when(
            F.col("_opens"), F.col("_before") + F.col("_kept") * F.col("_two")), ignorenulls=True).over(so_far))
        .withColumn("_level", F.col("_own") + F.exp(inside) * F.col("_start"))
        .drop("_bin", "_base", "_opens", "_own", "_before", "_kept", "_one", "_two", "_start")
    )


def with_ema(
    frame: DataFrame, value: str, span: int, key: str = "symbol", out: str = "ema", block: int = EMA_BLOCK
) -> DataFrame:
    """Exponential average with gap decay (recursive form, weights decay over missed dates), as a parallel scan.

    With ``d = (1 - a) ** gap`` since the last observation, one makes the level ``(d * level + a * x) / (d + a)``: an affine
    map. Maps compose, so a series is cut into blocks of the axis. A block is folded as if its first observation began the
    series; what the level before would have added to that observation reaches every later row times the product of the
    factors in between, which is kept as a logarithm. Blocks are then single maps, and ``affine_scan`` over these, one row
    for every block of a series, gives the level that each begins with. Only built-in functions are used; blocks are
    short, as the state of a fold is copied at every step.
    """
    alpha = 2 / (span + 1)
    rest = [name for name in frame.columns if name not in (key, "date_idx")]
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = F.sort_array(F.collect_list(F.struct("date_idx", x.alias("x"), F.struct(*rest).alias("rest"))))
    blocks = frame.groupBy(key, F.floor(F.col("date_idx") / block).alias("_block")).agg(rows.alias("_rows"))
    repeated = F.size(F.array_distinct(F.transform("_rows", lambda row: row["date_idx"]))) < F.size("_rows")
    blocks = blocks.withColumn("_rows", F.when(
        repeated, F.raise_error(F.lit("duplicate date in a series")).cast(blocks.schema["_rows"].dataType)).otherwise(F.col("_rows")))

    def decay(at: Column, seen: Column) -> Column:
        return F.pow(F.lit(1 - alpha), at - seen)

    def fold(state: Column, row: Column) -> Column:
        d, fresh, missing = decay(row["date_idx"], state["seen"]), state["level"].isNull(), row["x"].isNull()
        level = F.when(missing, state["level"]).when(fresh, row["x"]).otherwise(
            (d * state["level"] + alpha * row["x"]) / (d + alpha))
        # The logarithm of a vanished factor is null; far below any weight that a double holds beside the newest is enough.
        factor = F.when(missing | fresh, state["factor"]).otherwise(
            state["factor"] + F.coalesce(F.log(d / (d + alpha)), F.lit(-1e3)))
        return F.struct(
            level.alias("level"), factor.alias("factor"), F.when(missing, state["seen"]).otherwise(row["date_idx"]).alias("seen"),
            F.concat(state["done"], F.array(F.struct(level.alias("level"), factor.alias("factor")))).alias("done"))

    number, place = F.lit(None).cast("double"), F.lit(None).cast(frame.schema["date_idx"].dataType)
    none = F.array().cast("array<struct<level:double,factor:double>>")
    first = F.get(F.filter("_rows", lambda row: row["x"].isNotNull()), F.lit(0))
    blocks = blocks.withColumn("_end", F.aggregate(
        "_rows", F.struct(number.alias("level"), F.lit(0.0).alias("factor"), place.alias("seen"), none.alias("done")), fold))
    blocks = cut(blocks)  # read twice, for the maps and for the rows
    maps = blocks.select(F.col(key).alias("_series"), F.col("_block").alias("_at"), first.alias("_first"), "_end.level", "_end.factor", "_end.seen")
    along = Window.partitionBy("_series").orderBy("_at")
    maps = maps.withColumn("_seen", F.last("seen", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    d = decay(F.col("_first.date_idx"), F.col("_seen"))
    kept = F.coalesce(F.log(d / (d + alpha)), F.lit(-REACH))
    factor = F.when(F.col("_first").isNull() | F.col("_seen").isNull(), 0.0).otherwise(F.greatest(F.lit(-REACH), F.col("factor") + kept))
    maps = maps.withColumn("_factor", factor).withColumn("_term", F.when(F.col("_first").isNull(), 0.0).when(
        F.col("_seen").isNull(), F.col("level")).otherwise(F.col("level") - F.exp("_factor") * F.col("_first.x")))
    scanned = affine_scan(maps.select("_series", "_at", "_seen", "_factor", "_term"), ["_series"], "_at", "_factor", "_term")
    starts = scanned.select("_series", "_at", "_seen", F.when(F.col("_seen").isNotNull(), F.lag("_level").over(along)).alias("_before"))

    def added(level: Column, seen: Column, at: Column, x: Column) -> Column:
        """What a level before a first observation adds to it; nothing where there was none."""
        weight = decay(at, seen)
        return F.coalesce(weight / (weight + alpha) * (level - x), F.lit(0.0))

    joined = blocks.join(starts, blocks[key].eqNullSafe(starts["_series"]) & (blocks["_block"] == starts["_at"]))
    joined = joined.withColumn("_added", added(F.col("_before"), F.col("_seen"), first["date_idx"], first["x"]))
    level = F.zip_with("_rows", "_end.done", lambda row, done: F.struct(
        row["date_idx"].alias("date_idx"), row["rest"].alias("rest"),
        F.coalesce(done["level"] + F.exp(done["factor"]) * F.col("_added"), F.col("_before")).alias(out)))
    return joined.select(key, F.inline(level)).select(key, "date_idx", "rest.*", out).select(*frame.columns, out)


BLOCK = 65_536  # positions in a block of a long series


def in_blocks(frame: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], span: int, key: str = "symbol",
              order: str = "date_idx", block: int = BLOCK) -> DataFrame:
    """Add columns of RANGE windows that look at most ``span`` positions back, for series of any length.

    A series is cut into blocks of positions and a block also gets the rows up to ``span`` before it, its halo; windows run
    inside a block, and only its own rows are kept. The result is that of the same windows over whole series, but no task
    needs a whole series. Only the halo is sent twice.
    """
    block = max(block, span, 1)
    own = F.floor(F.col(order) / block)
    near_end = F.col(order) - own * block >= block - span
    spread = frame.withColumns({
        "_own": own, "_block": F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))})
    window = Window.partitionBy(key, "_block").orderBy(order)
    return (
        spread.withColumns({name: build(window) for name, build in columns.items()})
        .where("_own = _block").select(*frame.columns, *columns)
    )


def fill_in_blocks(frame: DataFrame, value: str, out: str, key: str = "symbol", order: str = "date_idx",
                   block: int = BLOCK) -> DataFrame:
    """Forward fill for series of any length: rows are filled inside a block, and what a block starts with is carried to it
    from the blocks before, of which one row each is looked at."""
    rows = frame.withColumn("_block", F.floor(F.col(order) / block))
    seen = F.when(F.col(value).isNotNull(), F.col(order))
    along = Window.partitionBy("_series").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(F.col(key).alias("_series"), F.col("_block").alias("_at")).agg(F.max_by(value, seen).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(along)).drop("_last")
    )
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (
        rows.join(carried, rows[key].eqNullSafe(carried["_series"]) & (rows["_block"] == carried["_at"]))
        .withColumn(out, F.coalesce(forward_fill(value, inside), "_carried")).select(*frame.columns, out)
    )


def forward_fill(value: str | Column, window: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def next_valid(value: str | Column, key: str | list[str], order: str = "date_idx",
               include_current: bool = False) -> Column:
    """First non-null value after (or on) the current row: a running last in reverse order."""
    keys = [key] if isinstance(key, str) else key
    backwards = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    end = 0 if include_current else -1
    return F.last(value, ignorenulls=True).over(
        backwards.rowsBetween(Window.unboundedPreceding, end)
    )


def drawdown(value: str, window: WindowSpec) -> Column:
    peak = F.max(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return ratio(F.col(value), peak) - 1


def grid(frame: DataFrame, axis: DataFrame, key: str = "symbol") -> DataFrame:
    """Every (series, date) pair, by exploding the date axis (a bounded array) per series."""
    days = axis.agg(F.sort_array(F.collect_list(F.struct("date_idx", "trade_date"))).alias("d"))
    exploded = frame.select(key).distinct().select(key, F.explode(days.scalar()).alias("day"))
    return exploded.select(key, "day.trade_date", "day.date_idx")


def densify(frame: DataFrame, axis: DataFrame | None = None, key: str = "symbol") -> DataFrame:
    """Dense panel: the frame's columns on every (series, date), null where no row exists."""
    axis = date_axis(frame) if axis is None else axis
    return grid(frame, axis, key).join(frame, [key, "trade_date"], "left")


def with_period_start(axis: DataFrame, unit: str) -> DataFrame:
    """Flag the first axis date of every period and number the periods (the epoch)."""
    order = Window.orderBy("trade_date")
    key = period_key(F.col("trade_date"), unit)
    previous = F.lag("period").over(order)
    flagged = axis.withColumn("period", key).withColumn(
        "is_start", previous.isNull() | (previous != F.col("period"))
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn("epoch", F.sum(F.col("is_start").cast("int")).over(running))


def carry_to_dates(picks: DataFrame, epochs: DataFrame) -> DataFrame:
    """Repeat the picks made on each epoch's first date on every date of that epoch.

    ``epochs`` is a date frame (bounded by the calendar); ``picks`` holds only selected rows.
    """
    days = epochs.select("epoch", "trade_date")
    return picks.join(F.broadcast(days), "epoch")


def latch(enter: Column, leave: Column, window: WindowSpec) -> Column:
    """State that switches on at ``enter``, off at ``leave`` and otherwise keeps its value."""
    event = F.when(enter, F.lit(True)).when(leave, F.lit(False))
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(running), F.lit(False))


def islands(days: DataFrame, position: str, keys: list[str] | None = None,
            date: str = "cal_date") -> DataFrame:
    """Contiguous runs of ``position`` collapsed to (start, end, days)."""
    keys = keys or []
    numbered = Window.partitionBy(*keys).orderBy(position)
    tagged = days.withColumn("island", F.col(position) - F.row_number().over(numbered))
    return (
        tagged.groupBy(*keys, "island")
        .agg(
            F.min(date).alias("range_start"),
            F.max(date).alias("range_end"),
            F.count(F.lit(1)).alias("days"),
        )
        .drop("island")
    )


def keep_newest(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    A max-by aggregate, so duplicates collapse before the shuffle and a hot key stays small.
    """
    payload = [name for name in frame.columns if name not in keys]
    newest = F.max_by(F.struct(*payload), F.struct(*order)).alias("newest")
    columns = [F.col(f"newest.{name}").alias(name) for name in payload]
    return frame.groupBy(*keys).agg(newest).select(*keys, *columns).select(*frame.columns)


def top_k(frame: DataFrame, by: list[str], order: list[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group; Spark trims every task to ``k`` rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def percent_rank(value: str, by: list[str]) -> Column:
    """Average-rank percentile (ties share their mean rank) among non-null values."""
    everything = Window.partitionBy(*by)
    ordered = everything.orderBy(F.col(value).asc_nulls_last())
    ties = F.count(value).over(Window.partitionBy(*by, value))
    average = F.rank().over(ordered) + (ties - 1) / 2
    return F.when(F.col(value).isNotNull(), average / F.count(value).over(everything))
