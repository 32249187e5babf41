"""Catalogue: composite reviews, snapshot completeness, planning and refresh guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.constants import (
    BREADTH_BUCKETS,
    PERIODS,
    REVIEW_AVERAGE_ROWS,
    REVIEW_CONVERTIBLE_ROWS,
    REVIEW_COUNT_ROWS,
    REVIEW_RATIO_ROWS,
    REVIEW_TAIL_ROWS,
    REVIEW_UNDERLYING_ROWS,
)
from barloom.operators import quality as Q, review as R, snapshots as Snap
from barloom.plans import driver_views as V
from barloom.plans.catalogue import query, round_columns, rounded
from barloom.plans.oracle_views import r, statement
from barloom.session import cut

_QUOTED = [f'"{p}"' for p in PERIODS]


# ---- reviews -------------------------------------------------------------------------------------
def _bucket_sql(column: str, low, high) -> str:
    tests = [f"{column} IS NOT NULL"]
    if low is not None:
        tests.append(f"round({column}, 12) > {low}")
    if high is not None:
        tests.append(f"round({column}, 12) <= {high}")
    return f"count(*) FILTER ({' AND '.join(tests)})"


def _review_sql() -> str:
    rows = [f"SELECT '{label}' AS item, " + ", ".join(
        f"CAST({_bucket_sql(q, low, high)} AS DOUBLE) AS {q}" for q in _QUOTED) + " FROM rets"
        for label, low, high in BREADTH_BUCKETS]
    for name, expression in (
        ("stocks", "count({q})"), ("up", "count(*) FILTER ({q} > 0)"),
        ("down", "count(*) FILTER ({q} < 0)"), ("flat", "count(*) FILTER ({q} = 0)"),
        ("mean", r("avg({q})")), ("median", r("median({q})")),
    ):
        rows.append(f"SELECT '{name}', " + ", ".join(
            f"CAST({expression.format(q=q)} AS DOUBLE)" for q in _QUOTED) + " FROM rets")
    return " UNION ALL ".join(rows)


@query("c1_market_review", statement(_review_sql()))
def market_review(spark, root):
    """Breadth buckets plus the day summary's measures for every period."""
    returns = cut(R.period_returns(V.bars(spark, root)))
    buckets = R.breadth(returns).select(
        F.col("区间").alias("item"), *[F.col(p).cast("double").alias(p) for p in PERIODS])
    long = R.by_period(returns)
    stats = long.groupBy("period").agg(
        F.count("ret").cast("double").alias("stocks"),
        F.count_if(F.col("ret") > 0).cast("double").alias("up"),
        F.count_if(F.col("ret") < 0).cast("double").alias("down"),
        F.count_if(F.col("ret") == 0).cast("double").alias("flat"),
        F.avg("ret").alias("mean"),
    ).join(R.exact_median(long, "period", "ret"), "period")
    items = ["stocks", "up", "down", "flat", "mean", "median"]
    rows = round_columns(stats, "mean", "median").unpivot("period", items, "item", "value")
    return buckets.union(rows.groupBy("item").pivot("period", list(PERIODS)).agg(F.max("value")))


def _pct(expression: str) -> str:
    return f"coalesce(printf('%.2f%%', ({expression}) * 100), '')"


def _table_sql() -> str:
    rows: list[tuple[str, list[str], str]] = []

    def add(name, cells, source="rets", bias="''"):
        rows.append((name, cells, f"{bias} AS bias25 FROM {source}"))

    for name, e in zip(REVIEW_COUNT_ROWS, ("count({q})", "count(*) FILTER ({q} > 0)",
                       "count(*) FILTER ({q} < 0)", "count(*) FILTER ({q} = 0)"), strict=True):
        add(name, [f"CAST({e.format(q=q)} AS VARCHAR)" for q in _QUOTED])
    for label, low, high in BREADTH_BUCKETS:
        add(label, [_pct(f"{_bucket_sql(q, low, high)} / count({q})") for q in _QUOTED])
    for name, op in zip(REVIEW_RATIO_ROWS, (">", "<"), strict=True):
        add(name, [_pct(f"count(*) FILTER ({q} {op} 0) / count({q})") for q in _QUOTED])
    for name, fn in zip(REVIEW_AVERAGE_ROWS, ("avg", "median"), strict=True):
        add(name, [_pct(f"{fn}({q})") for q in _QUOTED])
    for name, fn in zip(REVIEW_CONVERTIBLE_ROWS, ("avg", "median"), strict=True):
        add(name, [_pct(f"{fn}({q})") for q in _QUOTED], "rets WHERE symbol LIKE '5%'")
    for name, fn in zip(REVIEW_UNDERLYING_ROWS, ("avg", "median"), strict=True):
        add(name, [_pct(f"{fn}({q})") for q in _QUOTED], "rets WHERE symbol LIKE '000%'")
    for symbol in ("000008.SZ", "000009.SZ"):
        add(symbol, [_pct(f"max({q})") for q in _QUOTED], f"rets WHERE symbol = '{symbol}'",
            _pct(f"(SELECT max(close / sma - 1) FROM bias25 WHERE symbol = '{symbol}')"))
    add(REVIEW_TAIL_ROWS[0], ["''"] * 4, "(SELECT 1)")
    add(REVIEW_TAIL_ROWS[1], [_pct(f"avg({q})") for q in _QUOTED], "rets WHERE symbol LIKE '5%'")
    at = "arg_max(equity, trade_date) FILTER (trade_date <= {})"
    cells = [_pct(f"{at.format('latest')} / {at.format(q)} - 1") for q in _QUOTED]
    add(REVIEW_TAIL_ROWS[2], cells, "nav, anchor_dates WHERE portfolio_id = '1-URGENT'")
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS row, '{name}' AS \"名称\", " + ", ".join(
            f"{cell} AS {q}" for cell, q in zip(cells, _QUOTED, strict=True))
        + f", {tail}" for i, (name, cells, tail) in enumerate(rows))


@query("a5_daily_review_table", statement(
    'SELECT row, "名称", "今年", "本月", "本周", "当天", bias25 AS "BIAS25" FROM t',
    bias25="""SELECT * FROM (SELECT symbol, trade_date, close, CASE WHEN count(close) OVER w = 25
      THEN avg(close) OVER w END AS sma FROM panel WINDOW w AS (PARTITION BY symbol
      ORDER BY date_idx RANGE BETWEEN 24 PRECEDING AND CURRENT ROW))
      WHERE trade_date = (SELECT max(trade_date) FROM bars)""",
    t=_table_sql()))
def daily_review_table(spark, root):
    bars = V.bars(spark, root)
    anchors = cut(R.review_anchors(bars))
    returns = cut(R.period_returns(bars, anchors=anchors))
    etf = R.return_summary(returns.where(F.col("symbol").startswith("5")))
    under = R.return_summary(returns.where(F.col("symbol").startswith("000")))
    names = {symbol: symbol for symbol in ("000008.SZ", "000009.SZ")}
    index = R.named_returns(returns, names, R.price_bias(bars, 25))
    nav = R.nav_period_returns(
        V.nav(spark, root).where(F.col("portfolio_id") == "1-URGENT"), anchors)
    return R.daily_review_table(returns, index, etf, under, None, nav)


@query("c2_review_gate", statement(
    """SELECT d AS trade_date, CASE WHEN d IS NULL THEN 'missing' WHEN day(d) % 2 = 0 THEN
         'complete' ELSE 'incomplete' END AS status FROM (SELECT DISTINCT unnest([latest, "今年",
         "本月", "本周", "当天"]) AS d FROM anchor_dates)"""))
def review_gate(spark, root):
    bars = V.bars(spark, root)
    status = bars.select("trade_date").distinct().withColumn("status", F.when(
        F.dayofmonth("trade_date") % 2 == 0, "complete").otherwise("incomplete"))
    return Snap.review_gate(status, R.review_anchors(bars))


@query("c22_latest_complete_review_day", statement(
    """SELECT asset_type, 'none' AS adjustment, max(trade_date) AS trade_date FROM bars
       WHERE day(trade_date) % 2 = 0 GROUP BY asset_type"""))
def latest_complete_review_day(spark, root):
    return Snap.latest_complete(snapshot_status(spark, root)).select(
        "asset_type", "adjustment", "trade_date")


# ---- snapshots -----------------------------------------------------------------------------------
def snapshot_status(spark, root):
    """Stored status: even days are complete, with their true symbol count."""
    even = F.dayofmonth("trade_date") % 2 == 0
    return Snap.snapshot_counts(V.bars(spark, root)).select(
        "asset_type", "adjustment", "trade_date", "symbol_count",
        F.when(even, "complete").otherwise("incomplete").alias("status"))


@query("a15_snapshot_counts", statement(
    """SELECT asset_type, adjustment, trade_date, count(*) AS row_count,
         count(DISTINCT symbol) AS symbol_count FROM bars GROUP BY 1, 2, 3"""))
def snapshot_counts(spark, root):
    return Snap.snapshot_counts(V.bars(spark, root))


@query("a16_symbol_digest", statement(
    """SELECT trade_date, sha256(string_agg(DISTINCT symbol, chr(10) ORDER BY symbol)) AS digest
       FROM bars GROUP BY trade_date"""))
def symbol_digest(spark, root):
    return Snap.symbol_digest(V.bars(spark, root), ["trade_date"])


def basic_snapshots(spark, root):
    """Stored market-cap snapshots; some claim a wrong count, some a wrong digest."""
    basic = V.basic(spark, root)
    facts = Snap.basic_facts(basic)
    day = F.dayofmonth("trade_date")
    return facts.select(
        "trade_date", F.when(day == 1, "observed").otherwise("complete").alias("status"),
        (F.col("symbols") + (day == 2).cast("int")).alias("symbol_count"),
        F.when(day == 3, F.lit("stale")).otherwise(F.col("digest")).alias("digest"))


@query("v12_basic_audit", statement(
    """SELECT DISTINCT trade_date, CASE WHEN day(trade_date) IN (1, 2, 3) THEN 'invalid' ELSE
         'valid' END AS status FROM basic"""))
def basic_audit(spark, root):
    return Snap.audit_basic(V.basic(spark, root), basic_snapshots(spark, root))


@query("j8_incomplete_basic_dates", statement(
    """SELECT trade_date FROM axis WHERE trade_date NOT IN
         (SELECT trade_date FROM basic WHERE day(trade_date) NOT IN (1, 2, 3))"""))
def incomplete_basic_dates(spark, root):
    return Snap.incomplete_basic_dates(
        V.bars(spark, root), V.basic(spark, root), basic_snapshots(spark, root))


def members(spark, root):
    """Snapshot members: stock bars, one dropped on the 11th and a stranger on the 12th."""
    stocks = V.bars(spark, root).where(F.col("asset_type") == "stock").select(
        "trade_date", "symbol")
    day = F.dayofmonth("trade_date")
    kept = stocks.where(~((day == 11) & (F.col("symbol") == "000010.SZ")))
    strangers = stocks.where(day == 12).select("trade_date").distinct().withColumn(
        "symbol", F.lit("999999.SZ"))
    return kept.union(strangers)


_MEMBERS = """SELECT trade_date, symbol FROM stock_bars WHERE NOT (day(trade_date) = 11 AND
    symbol = '000010.SZ') UNION ALL SELECT DISTINCT trade_date, '999999.SZ' FROM stock_bars
    WHERE day(trade_date) = 12"""


@query("v13_snapshot_deep_check", statement(
    """SELECT trade_date, count(*) FILTER (NOT m) AS unexpected, count(*) FILTER (NOT b) AS missing,
         0 AS duplicated, 0 AS bad_rows, 0 AS mislabelled,
         CASE WHEN bool_and(m AND b) THEN 'valid' ELSE 'invalid' END AS status FROM (
       SELECT coalesce(a.trade_date, c.trade_date) AS trade_date, c.symbol IS NOT NULL AS m,
         a.symbol IS NOT NULL AS b FROM stock_bars a FULL JOIN mem c ON a.symbol = c.symbol
         AND a.trade_date = c.trade_date) GROUP BY trade_date""", mem=_MEMBERS))
def snapshot_deep_check(spark, root):
    stocks = V.bars(spark, root).where(F.col("asset_type") == "stock")
    return Snap.deep_check(stocks, members(spark, root))


@query("j7_incomplete_market_dates", statement(
    """SELECT x.trade_date, s.status, s.symbol_count, coalesce(m.members, 0) AS members FROM axis x
       LEFT JOIN (SELECT trade_date, CASE WHEN day(trade_date) % 2 = 0 THEN 'complete' ELSE
           'incomplete' END AS status, count(DISTINCT symbol) AS symbol_count FROM stock_bars
           GROUP BY trade_date) s USING (trade_date)
       LEFT JOIN (SELECT trade_date, count(*) AS members FROM mem GROUP BY 1) m USING (trade_date)
       WHERE NOT coalesce(s.status = 'complete' AND s.symbol_count > 0 AND
         coalesce(m.members, 0) = s.symbol_count, false)""", mem=_MEMBERS))
def incomplete_market_dates(spark, root):
    status = snapshot_status(spark, root).where(F.col("asset_type") == "stock")
    return Snap.incomplete_market_dates(
        V.bars(spark, root), status.select("trade_date", "status", "symbol_count"),
        members(spark, root))


@query("j9_dates_touched", statement(
    """SELECT DISTINCT trade_date FROM mem WHERE symbol IN ('999999.SZ', '000012.SZ')""",
    mem=_MEMBERS))
def dates_touched(spark, root):
    bad = members(spark, root).where(F.col("symbol").isin("999999.SZ", "000012.SZ"))
    return Snap.dates_touched(members(spark, root), bad)


@query("v14_validation_sample", statement(
    """SELECT trade_date, symbol, pick FROM (SELECT trade_date, symbol, row_number() OVER
         (PARTITION BY trade_date ORDER BY sha256(strftime(trade_date, '%Y-%m-%d') || ':' || symbol))
         AS pick FROM bars) WHERE pick <= 3"""))
def validation_sample(spark, root):
    return Snap.validation_sample(V.bars(spark, root), 3)


@query("j10_missing_basic_symbols", statement(
    """SELECT symbol, trade_date FROM basic WHERE day(trade_date) = 8"""))
def missing_basic_symbols(spark, root):
    bars = V.bars(spark, root).where(F.dayofmonth("trade_date") != 8)
    return Snap.missing_basic_symbols(V.basic(spark, root), bars)


@query("j10_prior_complete_count", statement(
    """SELECT a.asset_type, 'none' AS adjustment, a.trade_date, coalesce((SELECT
           arg_max(b.n, b.trade_date) FROM c b WHERE b.asset_type = a.asset_type AND
           b.trade_date < a.trade_date AND day(b.trade_date) % 2 = 0), 0) AS prior_count FROM c a""",
    c="""SELECT asset_type, trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1, 2"""))
def prior_complete_count(spark, root):
    status = snapshot_status(spark, root)
    return Snap.prior_complete_counts(status, status)


_FACTS = """SELECT c.*, b.basic_count, b.basic_count IS NOT NULL AND day(c.trade_date) % 3 <> 0
      AS verified, CASE day(c.trade_date) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS answered,
      CASE WHEN day(c.trade_date) % 5 = 0 THEN 0 ELSE 16 END AS provider
    FROM (SELECT asset_type, trade_date, count(DISTINCT symbol) AS n FROM bars GROUP BY 1, 2) c
    LEFT JOIN (SELECT trade_date, count(*) AS basic_count FROM basic GROUP BY 1) b
      ON b.trade_date = c.trade_date AND c.asset_type = 'stock'"""
_FLOOR = "CASE WHEN coalesce({0}, 0) <= 0 THEN 0 ELSE greatest(1, floor({0} * 0.9) - 1) END"


def completeness_facts(spark, root):
    """Snapshot facts whose answer flags vary by day so that every branch is taken."""
    status = snapshot_status(spark, root)
    basic = V.basic(spark, root).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("basic_count")).withColumn("asset_type", F.lit("stock"))
    day = F.dayofmonth("trade_date")
    return (
        status.drop("status").join(basic, ["asset_type", "trade_date"], "left")
        .join(Snap.prior_complete_counts(status, status),
              ["asset_type", "adjustment", "trade_date"])
        .withColumns({
            "basic_verified": F.col("basic_count").isNotNull() & (day % 3 != 0),
            "missing_basic": F.lit(0),
            "provider_expected": F.when(day % 5 == 0, 0).otherwise(16),
            "response_complete": F.when(day % 4 == 0, True).when(day % 4 == 1, False),
            "response_limit": F.lit(6000),
        }))


@query("c13_completeness", statement(
    f"""SELECT asset_type, trade_date, symbol_count, CAST(expected AS BIGINT) AS expected_symbols,
          CASE WHEN expected > 0 AND symbol_count >= expected THEN 'complete' ELSE 'incomplete' END
            AS status
        FROM (SELECT asset_type, trade_date, n AS symbol_count, CASE
          WHEN answered AND verified THEN basic_count
          WHEN answered AND asset_type = 'stock' THEN n
          WHEN answered AND provider > 0 THEN {_FLOOR.format('provider')}
          WHEN answered AND prior > 0 THEN {_FLOOR.format('prior')}
          WHEN answered THEN configured
          WHEN NOT answered THEN greatest({_FLOOR.format('provider')}, 6001, n + 1)
          WHEN verified THEN greatest({_FLOOR.format('basic_count')}, {_FLOOR.format('provider')})
          WHEN provider > 0 THEN {_FLOOR.format('provider')}
          WHEN prior > 0 THEN {_FLOOR.format('prior')} ELSE configured END AS expected
        FROM (SELECT f.*, CASE WHEN asset_type = 'stock' THEN 10 ELSE 2 END AS configured,
            coalesce((SELECT arg_max(g.n, g.trade_date) FROM facts g WHERE
              g.asset_type = f.asset_type AND g.trade_date < f.trade_date
              AND day(g.trade_date) % 2 = 0), 0) AS prior FROM facts f))""", facts=_FACTS))
def completeness(spark, root):
    decided = Snap.completeness(completeness_facts(spark, root), {"stock": 10, "etf": 2}, 0.9, 1)
    return decided.select("asset_type", "trade_date", "symbol_count", "expected_symbols", "status")


# Bars without some symbols every eighth day, so that listed market caps have no bar.
_THIN = "NOT (day(trade_date) % 8 = 0 AND substr(symbol, 6, 1) IN ('3', '9'))"


@query("c13_missing_basic", statement(
    f"""SELECT c.trade_date, n AS symbol_count, basic_count, coalesce(missing, 0) AS missing_basic,
          CAST({_FLOOR.format('basic_count')} AS BIGINT) AS expected_symbols,
          CASE WHEN n >= {_FLOOR.format('basic_count')} AND coalesce(missing, 0) = 0 THEN 'complete' ELSE 'incomplete' END AS status
        FROM (SELECT trade_date, count(DISTINCT symbol) AS n FROM thin GROUP BY 1) c
        JOIN (SELECT trade_date, count(*) AS basic_count FROM basic GROUP BY 1) b USING (trade_date)
        LEFT JOIN (SELECT trade_date, count(DISTINCT symbol) AS missing FROM basic ANTI JOIN thin USING (symbol, trade_date)
                   WHERE symbol NOT LIKE '200%.SZ' AND symbol NOT LIKE '900%.SH' GROUP BY 1) m USING (trade_date)""",
    thin=f"SELECT * FROM bars WHERE asset_type = 'stock' AND {_THIN}"))
def missing_basic_in_completeness(spark, root):
    """The floor that market caps set, with the listed symbols that have no bar counted from the tables."""
    thin = V.bars(spark, root).where(F.expr(f"asset_type = 'stock' AND {_THIN}"))
    basic = V.basic(spark, root)
    missing = Snap.missing_basic_symbols(basic, thin).groupBy("trade_date").agg(F.count(F.lit(1)).alias("missing_basic"))
    facts = (
        thin.groupBy("asset_type", "trade_date").agg(F.count_distinct("symbol").alias("symbol_count"))
        .join(basic.groupBy("trade_date").agg(F.count(F.lit(1)).alias("basic_count")), "trade_date")
        .join(missing, "trade_date", "left").fillna(0, ["missing_basic"])
        .withColumns({"basic_verified": F.lit(True), "provider_expected": F.lit(0), "prior_count": F.lit(0),
                      "response_complete": F.lit(None).cast("boolean"), "response_limit": F.lit(6000)}))
    decided = Snap.completeness(facts, {"stock": 10}, 0.9, 1)
    return decided.select("trade_date", "symbol_count", "basic_count", "missing_basic", "expected_symbols", "status")


@query("a17_completeness_totals", statement(
    f"""SELECT asset_type, count(*) FILTER (answered AND verified AND n >= basic_count) AS verified_ok
        FROM facts GROUP BY asset_type""", facts=_FACTS))
def completeness_totals(spark, root):
    decided = Snap.completeness(completeness_facts(spark, root), {"stock": 10, "etf": 2}, 0.9, 1)
    good = F.coalesce(F.col("response_complete"), F.lit(False)) & F.col("basic_verified") & (
        F.col("status") == "complete")
    return decided.groupBy("asset_type").agg(F.count_if(good).alias("verified_ok"))


@query("c14_incomplete_dates", statement(
    """SELECT 'market' AS kind, count(*) AS dates FROM axis WHERE trade_date NOT IN
         (SELECT trade_date FROM stock_bars WHERE day(trade_date) % 2 = 0
            AND day(trade_date) <> 12)
       UNION ALL SELECT 'basic', count(*) FROM axis WHERE trade_date NOT IN
         (SELECT trade_date FROM basic WHERE day(trade_date) NOT IN (1, 2, 3))"""))
def incomplete_dates(spark, root):
    market = incomplete_market_dates(spark, root).agg(F.count(F.lit(1)).alias("dates")).select(
        F.lit("market").alias("kind"), "dates")
    basic = incomplete_basic_dates(spark, root).agg(F.count(F.lit(1)).alias("dates")).select(
        F.lit("basic").alias("kind"), "dates")
    return market.union(basic)


@query("c15_missing_ranges", statement(
    """SELECT symbol, min(trade_date) AS range_start, max(trade_date) AS range_end,
         count(*) AS days FROM (
       SELECT g.symbol, g.trade_date, g.date_idx - row_number() OVER (PARTITION BY g.symbol
         ORDER BY g.date_idx) AS island
       FROM (SELECT symbol, trade_date, date_idx FROM (SELECT DISTINCT symbol FROM bars UNION ALL
             SELECT '999999.SZ') CROSS JOIN axis) g
       WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = g.symbol
           AND b.trade_date = g.trade_date)
         AND NOT (g.symbol = '000010.SZ' AND day(g.trade_date) < 10))
       GROUP BY symbol, island"""))
def missing_ranges(spark, root):
    bars = V.bars(spark, root)
    days = bars.select("trade_date").distinct()
    empties = Snap.confirmed_empty(
        days.where(F.dayofmonth("trade_date") < 10).withColumn("symbol", F.lit("000010.SZ")),
        F.lit("2100-01-01").cast("date"))
    extra = spark.range(1).select(F.lit("999999.SZ").alias("symbol"))
    return Snap.missing_ranges(bars, empties, days, bars.select("symbol").union(extra))


@query("c16_refresh_guard", statement(
    """SELECT symbol, count(*) AS lost_dates, min(trade_date) AS first_lost FROM bars
       WHERE symbol LIKE '510%' AND year(trade_date) = 1997 GROUP BY symbol"""))
def refresh_guard(spark, root):
    cached = V.bars(spark, root)
    refreshed = cached.where(~(F.col("symbol").startswith("510")
                               & (F.year("trade_date") == 1997)))
    return Snap.dropped_cached_dates(cached, refreshed)


@query("c17_basic_refresh_guard", statement(
    """SELECT trade_date, symbols, dropped, CASE
           WHEN day(trade_date) % 2 = 0 AND (dropped > 0 OR NOT answered) THEN 'refused'
           WHEN answered THEN 'complete' ELSE 'observed' END AS verdict FROM (
       SELECT *, symbols > 0 AND CASE WHEN day(trade_date) % 5 = 0 THEN symbols >= 8
           ELSE day(trade_date) % 3 = 0 END AS answered FROM (
       SELECT trade_date, count(*) FILTER (keep) AS symbols, count(*) FILTER (NOT keep) AS dropped
       FROM (SELECT trade_date, NOT (day(trade_date) = 6 AND symbol = '000010.SZ')
               AND day(trade_date) NOT IN (8, 9) AS keep FROM basic) GROUP BY trade_date))"""))
def basic_refresh_guard(spark, root):
    previous = V.basic(spark, root)
    day = F.dayofmonth("trade_date")
    incoming = previous.where(~((day == 6) & (F.col("symbol") == "000010.SZ")) & ~day.isin(8, 9))
    answer = F.when(day % 5 == 0, F.lit(None).cast("boolean")).otherwise(day % 3 == 0)
    return Snap.basic_refresh_guard(previous, incoming, answer, day % 2 == 0, F.lit(8))


@query("v11_market_cap_report", statement(
    """SELECT trade_date, n AS rows, dup AS duplicates, b AS b_shares, bad,
         CASE WHEN n = 0 THEN 'missing' WHEN day(trade_date) = 3 THEN 'foreign'
           WHEN dup + b + bad > 0 THEN 'invalid' ELSE 'valid' END AS verdict
       FROM (SELECT trade_date, CASE WHEN day(trade_date) = 4 THEN 0
           ELSE count(*) + CASE WHEN day(trade_date) = 5 THEN count(*) FILTER (symbol < '000010') ELSE 0 END END AS n,
         CASE WHEN day(trade_date) = 5 THEN count(*) FILTER (symbol < '000010') ELSE 0 END AS dup,
         CASE WHEN day(trade_date) = 7 THEN count(*) FILTER (symbol < '000010') ELSE 0 END AS b,
         CASE WHEN day(trade_date) = 11 THEN count(*) FILTER (symbol < '000010') ELSE 0 END AS bad
       FROM basic GROUP BY trade_date)"""))
def market_cap_report(spark, root):
    basic = V.basic(spark, root).select("symbol", "trade_date", "total_mv")
    day, low = F.dayofmonth("trade_date"), F.col("symbol") < "000010"
    broken = basic.where(day != 4).withColumns({
        "symbol": F.when((day == 7) & low, F.concat(F.lit("9"), F.substring("symbol", 2, 5), F.lit(".SH"))).otherwise(
            F.col("symbol")),
        "total_mv": F.when((day == 11) & low, -1.0).otherwise(F.col("total_mv"))})
    delivered = broken.union(basic.where((day == 5) & low))
    return Snap.market_cap_report(delivered, basic.where(day != 3).select("trade_date"))


@query("c18_calendar_coverage", statement(
    """SELECT cal_date FROM calendar WHERE cal_date < DATE '1999-06-01' OR day(cal_date) > 15"""))
def calendar_coverage(spark, root):
    stamp = F.when(F.dayofmonth("cal_date") > 15, F.lit("1999-06-02 00:00:00")).otherwise(
        F.lit("1999-05-01 00:00:00")).cast("timestamp_ntz")
    coverage = V.calendar(spark, root).withColumn("updated_at", stamp)
    return Snap.covered_calendar(coverage, F.lit("1999-06-01").cast("date"),
                                 F.lit("1999-06-01 00:00:00").cast("timestamp_ntz"))


@query("v16_calendar_complete", statement(
    """SELECT CAST(max(trade_date) - min(trade_date) + 1 AS BIGINT) AS expected_days,
         count(*) AS covered_days, count(*) = max(trade_date) - min(trade_date) + 1 AS complete
       FROM axis"""))
def calendar_complete(spark, root):
    days = V.calendar(spark, root)
    ends = days.agg(F.struct(F.min("cal_date").alias("a"), F.max("cal_date").alias("b"))
                    .alias("ends")).scalar()
    return Snap.calendar_complete(spark, ends["a"], ends["b"], days)


@query("c21_status_upsert", statement(
    """SELECT asset_type, 'none' AS adjustment, trade_date, CASE WHEN day(trade_date) % 2 = 0
         OR day(trade_date) % 3 = 0 THEN 'complete' ELSE 'incomplete' END AS status,
         CASE WHEN day(trade_date) % 2 = 0 AND day(trade_date) % 3 <> 0 THEN 1 ELSE 2 END
           AS checked_at FROM (SELECT DISTINCT asset_type, trade_date FROM bars)"""))
def status_upsert(spark, root):
    stored = snapshot_status(spark, root).drop("symbol_count").withColumn("checked_at", F.lit(1))
    third = F.dayofmonth("trade_date") % 3 == 0
    incoming = stored.withColumns({
        "status": F.when(third, "complete").otherwise("incomplete"), "checked_at": F.lit(2)})
    return Snap.upsert_status(stored, incoming)


@query("c21_failed_audit_downgrade", statement(
    """SELECT DISTINCT trade_date, CASE WHEN day(trade_date) % 2 = 0 AND day(trade_date) NOT IN
         (1, 2, 3) THEN 'complete' ELSE 'incomplete' END AS status FROM basic"""))
def failed_audit_downgrade(spark, root):
    audit = Snap.audit_basic(V.basic(spark, root), basic_snapshots(spark, root))
    stored = V.basic(spark, root).select("trade_date").distinct().withColumn("status", F.when(
        F.dayofmonth("trade_date") % 2 == 0, "complete").otherwise("incomplete"))
    return Snap.downgrade_failed(stored, audit)


@query("k7_latest_complete_before", statement(
    """SELECT asset_type, 'none' AS adjustment, max(trade_date) AS trade_date FROM bars WHERE
         day(trade_date) % 2 = 0 AND trade_date < DATE '1998-07-05' GROUP BY asset_type"""))
def latest_complete_before(spark, root):
    return Snap.latest_complete(snapshot_status(spark, root),
                                F.lit("1998-07-05").cast("date"))


@query("v18_market_history", statement(
    """SELECT count(DISTINCT trade_date) AS dates, count(DISTINCT trade_date) >= 122 AS enough
       FROM bars WHERE trade_date < DATE '1995-06-01'"""))
def market_history(spark, root):
    return Q.market_history(V.bars(spark, root), 122, F.lit("1995-06-01").cast("date"))


@query("c19_correlation_research", statement(
    f"""SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, {r('corr(a.ret, b.ret)', 7)} AS corr
        FROM ret1 a JOIN ret1 b ON a.trade_date = b.trade_date AND a.symbol <= b.symbol
        GROUP BY 1, 2""",
    ret1="""SELECT p.symbol, p.trade_date, p.close / q.close - 1 AS ret FROM etf_panel p
            JOIN etf_panel q ON q.symbol = p.symbol AND q.date_idx = p.date_idx - 1"""))
def correlation_research(spark, root):
    from barloom.operators.stats import return_correlation

    names = [f"51000{i}.SH" for i in range(4, 8)]
    found = return_correlation(V.bars(spark, root), names)
    return found.withColumn("corr", rounded("corr", 7))
