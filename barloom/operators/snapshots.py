"""Calendars, coverage, snapshot completeness and refresh guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.normalize import finite, is_b_share, to_number
from barloom.operators.panel import islands, keep_newest
from barloom.operators.quality import DataQualityError


# ---- dates -----------------------------------------------------------------------------------
def calendar_days(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """Every calendar day in [start, end]; the range bounds the size."""
    return spark.range(1).select(F.explode(F.sequence(start, end)).alias("cal_date"))


def trading_days(calendar: DataFrame) -> DataFrame:
    """Open days of a calendar in either vendor shape."""
    if "cal_date" in calendar.columns:
        opened = to_number(F.col("is_open")) if "is_open" in calendar.columns else F.lit(0)
        days = calendar.where(F.coalesce(opened, F.lit(0)) == 1).select("cal_date")
    elif "calendar_date" in calendar.columns:
        flag = F.col("is_trading_day").cast("string")
        days = calendar.where(flag == "1").select(F.col("calendar_date").alias("cal_date"))
    else:
        raise ValueError("the calendar needs cal_date or calendar_date")
    return days.select(F.col("cal_date").cast("date").alias("cal_date")).distinct()


def missing_calendar_days(spark: SparkSession, start: Column, end: Column,
                          covered: DataFrame) -> DataFrame:
    return calendar_days(spark, start, end).join(
        F.broadcast(covered.select("cal_date").distinct()), "cal_date", "left_anti"
    )


def missing_calendar_ranges(spark: SparkSession, start: Column, end: Column,
                            covered: DataFrame) -> DataFrame:
    missing = missing_calendar_days(spark, start, end, covered)
    return islands(missing.withColumn("day_no", F.unix_date("cal_date")), "day_no")


def calendar_complete(spark: SparkSession, start: Column, end: Column,
                      covered: DataFrame) -> DataFrame:
    """One row: expected days, covered days, and whether the whole range is covered."""
    inside = covered.where(F.col("cal_date").between(start, end))
    counted = inside.agg(F.count_distinct("cal_date").alias("covered_days"))
    expected = F.greatest(F.datediff(end, start) + 1, F.lit(0)).cast("bigint")
    return counted.select(
        expected.alias("expected_days"), "covered_days",
        (F.col("covered_days") == expected).alias("complete"),
    )


def covered_calendar(coverage: DataFrame, today: Column, fresh_after: Column) -> DataFrame:
    """Past days stay covered; today and later only while their entry is fresh enough."""
    settled = F.col("cal_date") < today
    return coverage.where(settled | (F.col("updated_at") >= fresh_after)).select("cal_date")


def replace_calendar_range(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Open days of the incoming span replace the stored ones of that span."""
    span = incoming.agg(F.min("cal_date").alias("first"), F.max("cal_date").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    # An empty delivery has no span and must not delete anything.
    kept = stored.where(~F.coalesce(F.col("cal_date").between(first, last), F.lit(False)))
    return kept.select("cal_date").union(trading_days(incoming))


def last_dates(frame: DataFrame, n: int, date: str = "trade_date") -> DataFrame:
    latest = frame.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    order = Window.orderBy(F.col(date).desc())
    return latest.select(date, F.row_number().over(order).cast("bigint").alias("back"))


def latest_complete(status: DataFrame, before: Column | None = None) -> DataFrame:
    """Latest complete snapshot date per (asset_type, adjustment), optionally before a date."""
    done = status.where(F.col("status") == "complete")
    if before is not None:
        done = done.where(F.col("trade_date") < before)
    return done.groupBy("asset_type", "adjustment").agg(F.max("trade_date").alias("trade_date"))


# ---- securities master -----------------------------------------------------------------------
def stack_masters(*parts: DataFrame) -> DataFrame:
    """Union status-wise master lists by column name; the later list wins per symbol."""
    tagged = [part.withColumn("list_no", F.lit(i)) for i, part in enumerate(parts)]
    stacked = tagged[0]
    for part in tagged[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return keep_newest(stacked, ["symbol"], ["list_no"]).drop("list_no")


def fill_delist_dates(master: DataFrame, fund_master: DataFrame) -> DataFrame:
    dates = fund_master.groupBy("symbol").agg(F.max("delist_date").alias("fund_delist_date"))
    return master.join(dates, "symbol", "left").select(
        *[c for c in master.columns if c != "delist_date"],
        F.coalesce("delist_date", "fund_delist_date").alias("delist_date"),
    )


def active_on(day: Column, list_date: Column, delist_date: Column) -> Column:
    """Listed on or before the day and not yet delisted (the delisting day itself is out)."""
    return (list_date <= day) & (delist_date.isNull() | (delist_date > day))


def active_counts(master: DataFrame, days: DataFrame, drop_b_shares: bool = True) -> DataFrame:
    """Listed securities per day, without a range join.

    Overlapping master rows of a security are united first. Each stretch adds one at its listing and removes one at its
    delisting; a running sum over the dates (calendar-bounded) gives the universe size.
    """
    listed = master.where(F.col("list_date").isNotNull())
    if drop_b_shares:
        listed = listed.where(~is_b_share(F.col("symbol")))
    open_ended = F.col("delist_date").isNull() | (F.col("delist_date") > F.col("list_date"))
    changes = _listed_stretches(listed.where(open_ended)).select(
        F.inline(F.array(
            F.struct(F.col("list_date").alias("day"), F.lit(1).alias("step")),
            F.struct(F.col("delist_date").alias("day"), F.lit(-1).alias("step")),
        ))
    ).where(F.col("day").isNotNull())
    marks = days.select(F.col("cal_date").alias("day")).distinct().withColumn("step", F.lit(0))
    steps = changes.withColumn("asked", F.lit(0)).union(marks.withColumn("asked", F.lit(1)))
    daily = steps.groupBy("day").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.withColumn("active", F.sum("step").over(running))
        .where(F.col("asked") == 1)
        .select(F.col("day").alias("cal_date"), "active")
    )


def _listed_stretches(listed: DataFrame) -> DataFrame:
    """(list_date, delist_date) of the stretches in which a security has any listing; null: still listed."""
    never = F.lit("9999-12-31").cast("date")
    rows = listed.select("symbol", "list_date", F.coalesce("delist_date", never).alias("end"))
    order = Window.partitionBy("symbol").orderBy("list_date", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("list_date") > before, F.lit(True)).cast("int")
    stretches = rows.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(order)).groupBy(
        "symbol", "stretch").agg(F.min("list_date").alias("list_date"), F.max("end").alias("end"))
    return stretches.select("list_date", F.nullif("end", never).alias("delist_date"))


def active_bars(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Bars of securities that are listed on the bar's date."""
    valid = master.select("symbol", "list_date", "delist_date")
    return bars.join(valid, "symbol").where(
        active_on(F.col("trade_date"), F.col("list_date"), F.col("delist_date"))
    ).select(*bars.columns)


# ---- snapshot facts --------------------------------------------------------------------------
def snapshot_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("asset_type", "adjustment", "trade_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("symbol").alias("symbol_count")
    )


def symbol_digest(frame: DataFrame, by: list[str]) -> DataFrame:
    """sha256 over the sorted distinct symbols of a snapshot (bounded by the listed universe)."""
    distinct = frame.select(*by, "symbol").where(F.col("symbol").isNotNull()).distinct()
    joined = F.array_join(F.array_sort(F.collect_list("symbol")), "\n")
    return distinct.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"))


def validation_sample(members: DataFrame, size: int) -> DataFrame:
    """Order-independent sample per date: smallest sha256 of ``date:symbol`` first."""
    key = F.sha2(F.concat_ws(":", F.col("trade_date").cast("string"), "symbol"), 256)
    window = Window.partitionBy("trade_date").orderBy("sample_key", "symbol")
    return (
        members.select("trade_date", "symbol").distinct().withColumn("sample_key", key)
        .withColumn("pick", F.row_number().over(window)).where(F.col("pick") <= size)
        .select("trade_date", "symbol", F.col("pick").cast("bigint").alias("pick"))
    )


def bad_market_cap() -> Column:
    """Row test shared by the market-cap checks: blank key, or not a positive finite number."""
    symbol = F.col("symbol")
    value = finite(F.col("total_mv").try_cast("double"))
    return (
        symbol.isNull() | (F.trim(symbol) == "") | F.col("trade_date").isNull()
        | value.isNull() | F.coalesce(value <= 0, F.lit(False))
    )


MARKET_CAP_COLUMNS = ("symbol", "trade_date", "total_mv")


def market_cap_report(basic: DataFrame, requested: DataFrame) -> DataFrame:
    """Whole check of a delivery of market caps against the requested dates: per date its counts and a verdict.

    A requested date without rows is missing and a delivered one that was not asked for is foreign. B shares do not belong to
    the delivery; a date with repeated symbols, B shares or bad rows is invalid.
    """
    absent = [name for name in MARKET_CAP_COLUMNS if name not in basic.columns]
    if absent:
        raise DataQualityError(f"market caps lack columns: {', '.join(absent)}")
    facts = basic.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count("symbol") - F.count_distinct("symbol")).alias("duplicates"),
        F.count_if(F.coalesce(is_b_share(F.col("symbol")), F.lit(False))).alias("b_shares"),
        F.count_if(bad_market_cap()).alias("bad"),
    ).withColumn("delivered", F.lit(True))
    asked = requested.select(F.col("trade_date").alias("asked_date")).distinct().withColumn("asked", F.lit(True))
    joined = facts.join(asked, F.col("trade_date").eqNullSafe(F.col("asked_date")), "full").select(
        F.coalesce("trade_date", "asked_date").alias("trade_date"), "asked", "delivered",
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("rows", "duplicates", "b_shares", "bad")])
    verdict = (
        F.when(F.col("delivered").isNull(), "missing").when(F.col("asked").isNull(), "foreign")
        .when(F.col("duplicates") + F.col("b_shares") + F.col("bad") > 0, "invalid").otherwise("valid"))
    return joined.select("trade_date", "rows", "duplicates", "b_shares", "bad", verdict.alias("verdict"))


def basic_facts(basic: DataFrame) -> DataFrame:
    """Per date: rows, distinct symbols, bad rows and the symbol digest."""
    counts = basic.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
        F.count_if(bad_market_cap()).alias("bad"),
    )
    return counts.join(symbol_digest(basic, ["trade_date"]), "trade_date", "left")


def audit_basic(basic: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Compare stored snapshot facts (date, status, symbol_count, digest) with the data."""
    facts = basic_facts(basic).withColumnRenamed("digest", "actual_digest")
    valid = (
        (F.col("status") == "complete") & (F.col("symbol_count") > 0)
        & (F.col("rows") == F.col("symbol_count")) & (F.col("symbols") == F.col("symbol_count"))
        & (F.col("bad") == 0) & (F.col("actual_digest") == F.col("digest"))
    )
    return snapshots.join(facts, "trade_date", "left").select(
        "trade_date",
        F.when(F.coalesce(valid, F.lit(False)), "valid").otherwise("invalid").alias("status"),
    )


def incomplete_basic_dates(days: DataFrame, basic: DataFrame, snapshots: DataFrame) -> DataFrame:
    audited = audit_basic(basic, snapshots).withColumnRenamed("status", "audit")
    return (
        days.select("trade_date").distinct().join(audited, "trade_date", "left")
        .where(F.coalesce(F.col("audit"), F.lit("invalid")) != "valid").select("trade_date")
    )


def incomplete_market_dates(days: DataFrame, snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Requested dates whose snapshot is absent, unfinished or short of its member list."""
    counted = members.groupBy("trade_date").agg(F.count("symbol").alias("members"))
    joined = (
        days.select("trade_date").distinct()
        .join(snapshots, "trade_date", "left").join(counted, "trade_date", "left")
    )
    good = (
        (F.col("status") == "complete") & (F.col("symbol_count") > 0)
        & (F.coalesce("members", F.lit(0)) == F.col("symbol_count"))
    )
    return joined.where(~F.coalesce(good, F.lit(False))).select(
        "trade_date", "status", "symbol_count", F.coalesce("members", F.lit(0)).alias("members")
    )


def dates_touched(members: DataFrame, bad_symbols: DataFrame) -> DataFrame:
    return members.join(bad_symbols.select("symbol").distinct(), "symbol", "left_semi").select(
        "trade_date"
    ).distinct()


def deep_check(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Per date: bars without a member, members without a bar, and illegal rows."""
    from barloom.operators.quality import bad_amounts, bad_ohlc, bad_required

    rows = bars.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad_required() | bad_ohlc() | bad_amounts(bars)).alias("bad"),
        F.count_if(F.col("adjustment") != F.lit("none")).alias("mislabelled"),
    )
    expected = members.select("trade_date", "symbol").distinct().withColumn("member", F.lit(True))
    matched = rows.join(expected, ["trade_date", "symbol"], "full_outer")
    facts = matched.groupBy("trade_date").agg(
        F.count_if(F.col("member").isNull()).alias("unexpected"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_rows"),
        F.coalesce(F.sum("mislabelled"), F.lit(0)).alias("mislabelled"),
    )
    problems = ("unexpected", "missing", "duplicated", "bad_rows", "mislabelled")
    clean = sum((F.col(c) for c in problems[1:]), F.col(problems[0])) == 0
    return facts.withColumn("status", F.when(clean, "valid").otherwise("invalid"))


# ---- completeness decision -------------------------------------------------------------------
def reference_floor(expected: Column, ratio: float, tolerance: int = 0) -> Column:
    floor = F.greatest(F.lit(1), F.floor(expected * ratio) - tolerance)
    return F.when(F.coalesce(expected, F.lit(0)) <= 0, F.lit(0)).otherwise(floor).cast("bigint")


def prior_complete_counts(days: DataFrame, status: DataFrame) -> DataFrame:
    """For each (asset_type, adjustment, date): symbol count of the last complete date before."""
    keys = ["asset_type", "adjustment"]
    marks = status.where(F.col("status") == "complete").select(
        *keys, "trade_date", F.col("symbol_count").alias("complete_count"), F.lit(0).alias("asked")
    )
    wanted = days.select(
        *keys, "trade_date", F.lit(None).cast("bigint").alias("complete_count"),
        F.lit(1).alias("asked"),
    )
    merged = marks.union(wanted).groupBy(*keys, "trade_date").agg(
        F.max("complete_count").alias("complete_count"), F.max("asked").alias("asked")
    )
    before = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    prior = F.last("complete_count", ignorenulls=True).over(before)
    return merged.withColumn("prior_count", F.coalesce(prior, F.lit(0))).where(
        F.col("asked") == 1
    ).select(*keys, "trade_date", "prior_count")


def completeness(facts: DataFrame, configured: dict[str, int], ratio: float = 0.9,
                 tolerance: int = 0) -> DataFrame:
    """Expected size and verdict per snapshot.

    ``facts`` has one row per (asset_type, trade_date): symbol_count, basic_verified,
    basic_count, missing_basic, provider_expected, prior_count, response_complete (nullable)
    and response_limit.
    """
    pairs = [F.lit(x) for item in configured.items() for x in item]
    minimum = F.coalesce(
        F.element_at(F.create_map(*pairs), F.col("asset_type")) if pairs else F.lit(0), F.lit(0)
    ).cast("bigint")
    provider = F.coalesce(F.col("provider_expected"), F.lit(0))
    provider_floor = reference_floor(provider, ratio, tolerance)
    prior = F.coalesce(F.col("prior_count"), F.lit(0))
    prior_floor = reference_floor(prior, ratio, tolerance)
    basic_floor = reference_floor(F.col("basic_count"), ratio, tolerance)
    stock = F.col("asset_type") == "stock"
    verified = stock & F.col("basic_verified")
    answered = F.col("response_complete")
    expected = (
        F.when(answered & verified, F.col("basic_count"))
        .when(answered & stock, F.col("symbol_count"))
        .when(answered & (provider > 0), provider_floor)
        .when(answered & (prior > 0), prior_floor)
        .when(answered, minimum)
        .when(~answered, F.greatest(provider_floor, F.col("response_limit") + 1,
                                    F.col("symbol_count") + 1))
        .when(verified, F.greatest(basic_floor, provider_floor))
        .when(provider > 0, provider_floor)
        .when(F.col("asset_type") == "convertible_bond", minimum)
        .when(prior > 0, prior_floor)
        .otherwise(minimum)
    ).cast("bigint")
    missing = F.when(verified, F.col("missing_basic")).otherwise(F.lit(0))
    complete = (expected > 0) & (F.col("symbol_count") >= expected) & (missing == 0)
    return facts.withColumn("expected_symbols", expected).withColumn(
        "status", F.when(complete, "complete").otherwise("incomplete")
    )


def missing_basic_symbols(basic: DataFrame, bars: DataFrame) -> DataFrame:
    """Market-cap rows (without B shares) whose symbol has no bar that day."""
    wanted = basic.select("symbol", "trade_date").where(~is_b_share(F.col("symbol"))).distinct()
    return wanted.join(bars.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti")


def upsert_status(stored: DataFrame, incoming: DataFrame,
                  preserve_complete: bool = True) -> DataFrame:
    """Newest status per key; an incomplete result may not overwrite a complete marker."""
    keys = ["asset_type", "adjustment", "trade_date"]
    done = (F.col("status") == "complete").cast("int") if preserve_complete else F.lit(0)
    both = stored.withColumn("turn", 2 * done).unionByName(
        incoming.withColumn("turn", 2 * done + 1))
    return keep_newest(both, keys, ["turn", "checked_at"]).drop("turn")


def downgrade_failed(stored: DataFrame, audit: DataFrame) -> DataFrame:
    """A complete marker whose audit failed becomes incomplete."""
    failed = audit.where(F.col("status") == "invalid").select(
        "trade_date", F.lit(True).alias("failed")
    )
    status = F.when(F.col("failed") & (F.col("status") == "complete"), "incomplete").otherwise(
        F.col("status")
    )
    return stored.join(failed, "trade_date", "left").select(
        *[status.alias(c) if c == "status" else F.col(c) for c in stored.columns]
    )


# ---- planning and guards ---------------------------------------------------------------------
def missing_ranges(bars: DataFrame, empties: DataFrame, expected: DataFrame,
                   symbols: DataFrame) -> DataFrame:
    """Runs of expected trading days a symbol has neither bars nor confirmed-empty days for.

    Covered positions are compared with their successor, so the work follows the covered rows;
    the days x symbols grid is never built.
    """
    order = Window.orderBy("trade_date")
    axis = expected.select("trade_date").distinct().select(
        "trade_date", (F.row_number().over(order)).alias("pos")
    )
    size = axis.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = symbols.select("symbol").distinct()
    covered = (
        bars.select("symbol", "trade_date").union(empties.select("symbol", "trade_date"))
        .join(wanted, "symbol", "left_semi")
        .join(F.broadcast(axis), "trade_date").select("symbol", "pos").distinct()
    )
    ends = wanted.select(
        "symbol", F.explode(F.array(F.lit(0), (size + 1).cast("int"))).alias("pos")
    )
    w = Window.partitionBy("symbol").orderBy("pos")
    gaps = (
        covered.union(ends).withColumn("next", F.lead("pos").over(w))
        .where(F.col("next") - F.col("pos") > 1)
        .select("symbol", (F.col("pos") + 1).alias("first_pos"),
                (F.col("next") - 1).alias("last_pos"))
    )
    first = axis.select(F.col("pos").alias("first_pos"), F.col("trade_date").alias("range_start"))
    last = axis.select(F.col("pos").alias("last_pos"), F.col("trade_date").alias("range_end"))
    return gaps.join(F.broadcast(first), "first_pos").join(F.broadcast(last), "last_pos").select(
        "symbol", "range_start", "range_end",
        (F.col("last_pos") - F.col("first_pos") + 1).cast("bigint").alias("days"),
    )


def confirmed_empty(responses: DataFrame, today: Column) -> DataFrame:
    """Only days before today may be remembered as empty."""
    return responses.where(F.col("trade_date") < today).select("symbol", "trade_date")


def dropped_cached_dates(cached: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Symbols whose full refresh lacks dates of the cache: such a refresh must be refused."""
    lost = cached.select("symbol", "trade_date").join(
        refreshed.select("symbol", "trade_date"), ["symbol", "trade_date"], "left_anti"
    )
    return lost.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("lost_dates"), F.min("trade_date").alias("first_lost")
    )


def basic_refresh_guard(previous: DataFrame, incoming: DataFrame, response_complete: Column,
                        previous_complete: Column, floor: Column | None = None) -> DataFrame:
    """Per date: symbols, symbols dropped against the previous complete set, verdict.

    Where it is unknown whether the answer was complete, the number of symbols against ``floor`` decides, and without one the
    answer counts as incomplete. A date that came back empty is judged like any other, and is never complete.
    """
    now = incoming.where(~is_b_share(F.col("symbol"))).select("symbol", "trade_date").distinct()
    before = previous.where(~is_b_share(F.col("symbol"))).select("symbol", "trade_date").distinct()
    lost = before.join(now, ["symbol", "trade_date"], "left_anti").groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("dropped")
    )
    counts = now.groupBy("trade_date").agg(F.count(F.lit(1)).alias("symbols"))
    joined = counts.join(lost, "trade_date", "full").select(
        "trade_date", F.coalesce("symbols", F.lit(0)).alias("symbols"),
        F.coalesce("dropped", F.lit(0)).alias("dropped")
    )
    enough = F.lit(False) if floor is None else F.coalesce(F.col("symbols") >= floor, F.lit(False))
    answered = F.coalesce(response_complete, enough) & (F.col("symbols") > 0)
    known = F.coalesce(previous_complete, F.lit(False))
    refused = known & ((F.col("dropped") > 0) | ~answered)
    verdict = F.when(refused, "refused").when(answered, "complete").otherwise("observed")
    return joined.withColumn("verdict", verdict)


def review_gate(status: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor dates of a review with the status of their snapshot; all must be complete."""
    days = anchors.select(F.explode(F.array(*anchors.columns)).alias("trade_date")).distinct()
    return days.join(status.select("trade_date", "status"), "trade_date", "left").select(
        "trade_date", F.coalesce("status", F.lit("missing")).alias("status")
    )


def require_review_day(status: DataFrame, anchors_of, target=None):
    """Target day of a review whose anchors are all complete, or a refusal.

    ``status`` has (trade_date, status) and ``anchors_of(day)`` gives the anchor dates of a day. Without ``target`` the latest
    complete day is taken. An action: the anchors of one review are a handful of dates.
    """
    if target is None:
        target = status.where(F.col("status") == "complete").agg(F.max("trade_date")).first()[0]
    if target is None:
        raise DataQualityError("no complete day to review")
    open_days = review_gate(status, anchors_of(target)).where(F.col("status") != "complete").orderBy("trade_date").collect()
    if open_days:
        raise DataQualityError("review anchors are not complete: " + ", ".join(
            f"{row['trade_date']} {row['status']}" for row in open_days))
    return target


def symbol_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Symbols that only one of two sets has, with the side that has them."""
    both = first.select("symbol", F.lit(1).alias("a"), F.lit(0).alias("b")).union(
        second.select("symbol", F.lit(0), F.lit(1)))
    sides = both.groupBy("symbol").agg((F.max("a") == 1).alias("in_first"), (F.max("b") == 1).alias("in_second"))
    return sides.where(F.col("in_first") != F.col("in_second"))
