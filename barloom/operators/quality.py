"""Data-quality rules as reports: (rule, bad rows, examples), with an optional failing gate.

Predicates are plain columns, so any number of rules is one aggregate pass over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.constants import OHLC
from barloom.functions.normalize import (
    clock_minutes,
    finite,
    frequency_minutes,
    is_auction,
    whole_minute,
)

EXAMPLES = 3


class DataQualityError(ValueError):
    """Raised by ``require_clean`` when a report holds violations."""


def _number(name: str) -> Column:
    """Numeric value with NaN as null; infinities stay, so that the rules can report them."""
    return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def bad_required(minute: bool = False) -> Column:
    """Null or blank key, or a null (or unparsable, or NaN) price or volume."""
    keys = ["symbol", "trade_date"] + (["bar_time"] if minute else [])
    missing = [F.col(k).isNull() for k in keys] + [F.trim("symbol") == ""]
    missing += [_number(c).isNull() for c in (*OHLC, "volume")]
    return _any(missing)


def bad_ohlc() -> Column:
    high, low = _number("high"), _number("low")
    prices = [_number(c) for c in OHLC]
    return _any([
        high < F.greatest(_number("open"), _number("close"), low),
        low > F.least(_number("open"), _number("close"), high),
        F.least(*prices) <= 0,
        *[finite(p).isNull() & p.isNotNull() for p in prices],
    ])


def bad_amounts(frame: DataFrame) -> Column:
    """Negative or non-finite volume; an amount, when supplied, must be a finite number >= 0."""
    volume = _number("volume")
    tests = [volume < 0, finite(volume).isNull() & volume.isNotNull()]
    if "amount" in frame.columns:
        amount = _number("amount")
        tests.append(F.col("amount").isNotNull() & (finite(amount).isNull() | (amount < 0)))
    return _any(tests)


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def validate_bars(frame: DataFrame, minute: bool = False) -> DataFrame:
    """Report of the bar rules: one aggregate for row rules plus one keyed count for duplicates."""
    required = ["symbol", "trade_date", *OHLC, "volume"] + (["bar_time"] if minute else [])
    absent = sorted(set(required) - set(frame.columns))
    if absent:
        raise DataQualityError(f"bars lack columns: {', '.join(absent)}")
    key = ["symbol", "bar_time"] if minute else ["symbol", "trade_date"]
    no_amount = F.count_if(F.col("amount").isNull()) if "amount" in frame.columns else F.lit(0)
    facts = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_required(minute)).alias("required"),
        F.count_if(bad_ohlc()).alias("ohlc"),
        F.count_if(bad_amounts(frame)).alias("trade"),
        no_amount.cast("bigint").alias("no_amount"),
    )
    repeats = duplicate_keys(frame, key).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")
    )
    mostly_null = F.col("no_amount") > 0.2 * F.col("rows")
    found = [
        ("empty", "error", F.col("rows") == 0),
        ("required", "error", F.col("required")),
        ("duplicate", "error", repeats.scalar()),
        ("ohlc", "error", F.col("ohlc")),
        ("trade", "error", F.col("trade")),
        ("amount_mostly_null", "warning", F.when(mostly_null, F.col("no_amount")).otherwise(0)),
    ]
    rules = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"),
                 bad.cast("bigint").alias("bad_rows"))
        for rule, level, bad in found
    ])
    return facts.select(F.inline(rules))


def require_clean(report: DataFrame) -> None:
    """Action: raise when an error rule has bad rows (a report is a handful of rows)."""
    bad = report.where((F.col("level") == "error") & (F.col("bad_rows") > 0)).take(20)
    if bad:
        raise DataQualityError("; ".join(f"{row['rule']}: {row['bad_rows']} rows" for row in bad))


def examples(frame: DataFrame, condition: Column, by: list[str], show: str, shown: int = EXAMPLES) -> DataFrame:
    """Bad-row count per group with the first ``shown`` offending values.

    The sample is a bounded heap per group and task, never the whole group.
    """
    window = Window.partitionBy(*by).orderBy(show)
    bad = frame.where(condition)
    first = bad.withColumn("pick", F.row_number().over(window)).where(F.col("pick") <= shown)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(show)).alias("examples"))
    return bad.groupBy(*by).agg(F.count(F.lit(1)).alias("bad_rows")).join(listed, by)


# ---- minute rules ----------------------------------------------------------------------------
def off_grid(frequency: str) -> Column:
    """Bar time outside the sessions, off the frequency grid, or not on a whole minute."""
    step = frequency_minutes(frequency)
    clock = clock_minutes(F.col("bar_time"))
    morning, afternoon = clock - 570, clock - 780
    regular = whole_minute(F.col("bar_time")) & (
        ((morning > 0) & (morning <= 120) & (morning % step == 0))
        | ((afternoon >= 0) & (afternoon <= 120) & (afternoon % step == 0))
    )
    auction = (F.col("asset_type") == "stock") & (clock == 570) & whole_minute(F.col("bar_time"))
    return ~F.coalesce(regular | auction, F.lit(False))


def opening_placeholder() -> Column:
    """Synthetic ETF row at 09:31:00: all prices exactly 1.0 and nothing traded."""
    at_open = (clock_minutes(F.col("bar_time")) == 571) & (F.second("bar_time") == 0)
    flat = reduce(lambda a, b: a & b, [F.col(c) == 1.0 for c in OHLC])
    idle = (F.col("volume") == 0) & (F.coalesce("amount", F.lit(0.0)) == 0)
    return F.coalesce((F.col("asset_type") == "etf") & at_open & flat & idle, F.lit(False))


def conflicting_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows disagree on any bar value.

    Per value the smallest and largest are compared (nulls counted apart), so the test needs no
    set of distinct rows and stays a map-side aggregate however often a key repeats.
    """
    values = (*OHLC, "volume", "amount")
    tests = []
    for name in values:
        some_null = (F.count(F.lit(1)) > F.count(name)) & (F.count(name) > 0)
        tests.append(some_null | F.coalesce(F.min(name) != F.max(name), F.lit(False)))
    conflict = reduce(lambda a, b: a | b, tests)
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), conflict.alias("conflict")
    ).where("conflict").select(*keys, "n")


def minute_audit(frame: DataFrame, catalog: DataFrame, frequency: str) -> DataFrame:
    """Deep check of (symbol, year) slices against their catalog entry, all in one job."""
    year = F.year("bar_time")
    nulls = _any([F.col(c).isNull() for c in ("symbol", "bar_time", "trade_date", *OHLC, "volume")])
    wrong_values = bad_ohlc() | bad_amounts(frame)
    auction = is_auction(F.col("asset_type"), F.col("bar_time"))
    facts = frame.groupBy("symbol", year.alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("bar_time").alias("first_time"), F.max("bar_time").alias("last_time"),
        F.min("frequency").alias("f0"), F.max("frequency").alias("f1"),
        F.min("asset_type").alias("a0"), F.max("asset_type").alias("a1"),
        F.count_if(nulls).alias("null_keys"), F.count_if(wrong_values).alias("bad_values"),
        F.count_if(F.col("trade_date") != F.col("bar_time").cast("date")).alias("bad_dates"),
        F.count_if(off_grid(frequency)).alias("off_grid"),
        F.count_if(~F.col("is_auction").eqNullSafe(auction)).alias("bad_auctions"),
    )
    repeated = duplicate_keys(frame, ["symbol", "bar_time"]).groupBy(
        "symbol", year.alias("year")
    ).agg(F.count(F.lit(1)).alias("repeats"))
    joined = catalog.join(facts, ["symbol", "year"], "left").join(
        repeated, ["symbol", "year"], "left"
    )
    zero = F.lit(0)
    reason = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("n") != F.col("rows"), "row count")
        .when((F.col("first_time") != F.col("min_time"))
              | (F.col("last_time") != F.col("max_time")), "time range")
        .when((F.col("f0") != frequency) | (F.col("f1") != frequency), "frequency")
        .when((F.col("a0") != F.col("asset_type")) | (F.col("a1") != F.col("asset_type")),
              "asset type")
        .when((F.col("null_keys") > 0) | (F.col("bad_values") > 0), "null or illegal values")
        .when(F.col("bad_dates") > 0, "trade date")
        .when(F.col("off_grid") > 0, "session grid")
        .when(F.col("bad_auctions") > 0, "auction flag")
        .when(F.coalesce("repeats", zero) > 0, "duplicate keys")
        .otherwise("")
    )
    return joined.select(
        "symbol", "year", F.when(reason == "", "valid").otherwise("invalid").alias("status"),
        reason.alias("reason"),
    )


# ---- labels, weights, history ----------------------------------------------------------------
def label_check(frame: DataFrame, by: list[str], requested: str) -> DataFrame:
    """Groups carrying any adjustment label other than the requested one (or none at all)."""
    wrong = F.count_if(~F.col("adjustment").eqNullSafe(F.lit(requested)))
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), wrong.alias("mislabelled"))


def weight_violations(weights: DataFrame, by: list[str]) -> DataFrame:
    """Dates whose weights are short or sum to more than one."""
    return weights.groupBy(*by).agg(
        F.min("weight").alias("smallest"), F.sum("weight").alias("total")
    ).where((F.col("smallest") < -1e-12) | (F.col("total") > 1.000001))


def short_history(bars: DataFrame, universe: DataFrame, required: int,
                  before: Column) -> DataFrame:
    """Universe symbols with fewer than ``required`` distinct dates before a day."""
    history = bars.where(F.col("trade_date") < before)
    counts = history.groupBy("symbol").agg(F.count_distinct("trade_date").alias("dates"))
    return universe.select("symbol").distinct().join(counts, "symbol", "left").select(
        "symbol", F.coalesce("dates", F.lit(0)).alias("dates")
    ).where(F.col("dates") < required)


def market_history(bars: DataFrame, required: int, before: Column) -> DataFrame:
    """Market-wide variant: distinct dates over all symbols before a day."""
    dates = bars.where(F.col("trade_date") < before).agg(
        F.count_distinct("trade_date").alias("dates")
    )
    return dates.select("dates", (F.col("dates") >= required).alias("enough"))


def stale_symbols(bars: DataFrame, universe: DataFrame, day: Column) -> DataFrame:
    """Universe symbols without a bar on the day."""
    present = bars.where(F.col("trade_date") == day).select("symbol")
    return universe.select("symbol").distinct().join(present, "symbol", "left_anti")


def missing_market_caps(bars: DataFrame, basic: DataFrame) -> DataFrame:
    """Bars without a market cap, counted per date with a few examples."""
    joined = bars.select("symbol", "trade_date").join(
        basic.select("symbol", "trade_date", "total_mv"), ["symbol", "trade_date"], "left"
    )
    return examples(joined, F.col("total_mv").isNull(), ["trade_date"], "symbol")
