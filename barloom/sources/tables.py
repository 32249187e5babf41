"""Small vendor tables: daily frames, calendars, NAV, symbol lists and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.constants import (
    DAILY_COLUMNS,
    HOLDING_CODE_ALIASES,
    HOLDING_WEIGHT_ALIASES,
    NAV_DATE_ALIASES,
    NAV_VALUE_ALIASES,
    SYMBOL_LIST_ALIASES,
)
from barloom.functions import normalize as N
from barloom.operators.panel import keep_newest


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text (nothing is inferred)."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.toDF(*[name.lstrip("﻿").strip() for name in raw.columns])


def _first_of(frame: DataFrame, names) -> str | None:
    return next((name for name in names if name in frame.columns), None)


def canonical_daily(frame: DataFrame, provider: str, symbol: str | None = None,
                    rename: dict[str, str] | None = None, adjustment: str = "none") -> DataFrame:
    """Vendor daily rows -> canonical bars: rename, coerce, tag, drop rows without prices."""
    out = frame.withColumnsRenamed(rename or {})
    if "trade_date" not in out.columns:
        raise ValueError("the vendor frame has no date column")
    fallback = F.lit(symbol).cast("string")
    named = F.coalesce(F.col("symbol").cast("string"), fallback) if "symbol" in out.columns else (
        fallback)
    values = {
        name: N.to_number(F.col(name)) if name in out.columns else F.lit(None).cast("double")
        for name in ("open", "high", "low", "close", "volume", "amount")
    }
    return out.withColumns({
        "symbol": named, "trade_date": N.parse_date(F.col("trade_date")),
        "bar_time": F.lit(None).cast("timestamp_ntz"), "source": F.lit(provider),
        "adjustment": F.lit(adjustment), **values,
    }).select(*DAILY_COLUMNS).dropna(subset=["trade_date", "open", "high", "low", "close"])


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Back-adjusted bars. Every bar needs one positive factor on its date."""
    dated = keep_newest(
        factors.select("symbol", "trade_date", "adj_factor",
                       *[c for c in ("seq",) if c in factors.columns])
        .where(F.col("adj_factor").isNotNull()),
        ["symbol", "trade_date"], ["seq"] if "seq" in factors.columns else ["adj_factor"],
    ).select("symbol", "trade_date", "adj_factor")
    joined = bars.join(dated, ["symbol", "trade_date"], "left")
    usable = F.coalesce(F.col("adj_factor") > 0, F.lit(False))
    factor = F.when(usable, F.col("adj_factor")).otherwise(
        F.raise_error(F.concat(F.lit("no positive factor for "), F.col("symbol"), F.lit(" on "),
                               F.col("trade_date").cast("string"))).cast("double"))
    return joined.withColumns(N.adjusted_prices(factor)).drop("adj_factor")


def uncovered_factors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars whose date has no positive factor (what ``adjust_prices`` would refuse)."""
    good = factors.where(F.col("adj_factor") > 0).select("symbol", "trade_date")
    return bars.join(good, ["symbol", "trade_date"], "left_anti")


def attach_previous_close(bars: DataFrame, evidence: DataFrame) -> DataFrame:
    """Vendor previous closes, last row per (symbol, date), attached one to one."""
    rows = evidence.select("symbol", "trade_date", N.to_number(F.col("pre_close"))
                           .alias("pre_close"),
                           *[c for c in ("seq",) if c in evidence.columns])
    rows = rows.where(F.col("trade_date").isNotNull())
    rank = ["seq"] if "seq" in rows.columns else ["pre_close"]
    single = keep_newest(rows, ["symbol", "trade_date"], rank)
    return bars.join(single.select("symbol", "trade_date", "pre_close"),
                     ["symbol", "trade_date"], "left")


def fill_suspended(bars: DataFrame) -> DataFrame:
    """Zero-price placeholders confirmed by the previous close get flat prices.

    Adds ``suspended`` so that the number of repairs can be counted.
    """
    zero = (F.col("open") == 0) & (F.col("high") == 0) & (F.col("low") == 0)
    idle = (F.coalesce("volume", F.lit(0.0)) == 0) & (F.coalesce("amount", F.lit(0.0)) == 0)
    confirmed = N.is_close(F.col("close"), F.col("pre_close"))
    found = F.coalesce(zero & idle & (F.col("close") > 0) & confirmed, F.lit(False))
    flat = {c: F.when(F.col("suspended"), F.col("close")).otherwise(F.col(c))
            for c in ("open", "high", "low")}
    return bars.withColumn("suspended", found).withColumns(flat).drop("pre_close")


def read_nav(spark: SparkSession, path: str, portfolio_id: str) -> DataFrame:
    table = read_text_table(spark, path)
    day, value = _first_of(table, NAV_DATE_ALIASES), _first_of(table, NAV_VALUE_ALIASES)
    if day is None or value is None:
        raise ValueError(f"{path} needs a date column and a NAV column")
    return table.select(
        F.lit(portfolio_id).alias("portfolio_id"), N.parse_date(F.col(day)).alias("trade_date"),
        N.to_number(F.col(value)).alias("equity"),
    )


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised symbols of a list file; the last column is the fallback."""
    table = read_text_table(spark, path)
    column = _first_of(table, SYMBOL_LIST_ALIASES) or table.columns[-1]
    code = F.trim(F.coalesce(column, F.lit("")))
    return table.where(code != "").select(N.stock_symbol(code).alias("symbol")).distinct()


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    table = read_text_table(spark, path)
    code = _first_of(table, HOLDING_CODE_ALIASES)
    weight = _first_of(table, HOLDING_WEIGHT_ALIASES)
    if code is None or weight is None:
        raise ValueError(f"{path} needs a code column and a weight column")
    return table.select(
        N.stock_symbol(F.col(code)).alias("symbol"),
        F.coalesce(N.to_number(F.col(weight)), F.lit(0.0)).alias("weight"),
    )
