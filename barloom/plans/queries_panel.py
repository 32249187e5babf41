"""Catalogue: review aggregates, panel windows and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.constants import BREADTH_BUCKETS, PERIODS
from barloom.functions.normalize import code_excluded, log_bias, period_key
from barloom.operators import panel as P, review as R
from barloom.operators.stats import return_correlation, with_percent_rank
from barloom.plans import driver_views as V
from barloom.plans.catalogue import query, round_columns, rounded
from barloom.plans.oracle_views import r, statement

_QUOTED = [f'"{p}"' for p in PERIODS]


@query("a1_period_returns", statement(
    f'SELECT symbol, {", ".join(f"{r(q)} AS {q}" for q in _QUOTED)} FROM rets'))
def period_returns(spark, root):
    return round_columns(R.period_returns(V.bars(spark, root)), *PERIODS)


def _breadth_sql() -> str:
    rows = []
    for i, (label, low, high) in enumerate(BREADTH_BUCKETS):
        cells = []
        for q in _QUOTED:
            conditions = []
            if low is not None:
                conditions.append(f"round({q}, 12) > {low}")
            if high is not None:
                conditions.append(f"round({q}, 12) <= {high}")
            cells.append(f"count(*) FILTER ({' AND '.join(conditions)}) AS {q}")
        rows.append(f"SELECT {i} AS ordinal, '{label}' AS \"区间\", {', '.join(cells)} FROM rets")
    return " UNION ALL ".join(rows)


@query("a2_breadth", statement(_breadth_sql()))
def breadth(spark, root):
    return R.breadth(R.period_returns(V.bars(spark, root)))


@query("a3_day_summary", statement(
    f"""SELECT CAST((SELECT latest FROM anchor_dates) AS VARCHAR) AS as_of, count("当天") AS stocks,
          count(*) FILTER ("当天" > 0) AS up, count(*) FILTER ("当天" < 0) AS down,
          count(*) FILTER ("当天" = 0) AS flat, {r('median("当天")')} AS median_return,
          {r('avg("当天")')} AS mean_return FROM rets"""))
def day_summary(spark, root):
    bars = V.bars(spark, root)
    anchors = R.review_anchors(bars)
    summary = R.day_summary(R.period_returns(bars, anchors=anchors), anchors)
    return round_columns(summary, "median_return", "mean_return")


@query("a4_return_summary", statement(
    f"""SELECT period, {r('avg(ret)')} AS mean, {r('median(ret)')} AS median,
          count(ret) AS count FROM rets_long GROUP BY period"""))
def return_summary(spark, root):
    return round_columns(R.return_summary(R.period_returns(V.bars(spark, root))),
                         "mean", "median")


_FILLED = """SELECT g.symbol, g.trade_date, last_value(b.close IGNORE NULLS) OVER
      (PARTITION BY g.symbol ORDER BY g.trade_date) AS close
    FROM (SELECT symbol, trade_date FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN axis) g
    LEFT JOIN bars b USING (symbol, trade_date)"""


@query("a6_portfolio_returns", statement(
    "SELECT " + ", ".join(
        f"{r(f'sum(weight * (p0 / p{i} - 1)) / sum(weight)')} AS {q}"
        for i, q in enumerate(_QUOTED, 1)) + " FROM held",
    filled=_FILLED,
    held="SELECT h.weight, max(close) FILTER (f.trade_date = latest) AS p0, " + ", ".join(
        f"max(close) FILTER (f.trade_date = {q}) AS p{i}" for i, q in enumerate(_QUOTED, 1))
    + """ FROM holdings h JOIN filled f ON f.symbol = h.symbol || '.SZ', anchor_dates
         GROUP BY h.symbol, h.weight"""))
def portfolio_returns(spark, root):
    """Holdings valued at their last known close on every anchor."""
    bars = V.bars(spark, root)
    dense = P.densify(bars.select("symbol", "trade_date", "close"))
    filled = dense.withColumn("close", P.forward_fill("close", P.series()))
    returns = R.period_returns(filled, anchors=R.review_anchors(bars))
    return round_columns(
        R.portfolio_period_returns(returns, V.holdings(spark, root)), *PERIODS)


@query("j10_holding_gaps", statement(
    """SELECT h.symbol || '.SZ' AS symbol, p.period FROM holdings h
       CROSS JOIN (SELECT unnest(['今年', '本月', '本周', '当天']) AS period) p
       LEFT JOIN rets_long l ON l.symbol = h.symbol || '.SZ' AND l.period = p.period
       WHERE l.ret IS NULL"""))
def holding_gaps(spark, root):
    return R.holding_gaps(R.period_returns(V.bars(spark, root)), V.holdings(spark, root))


def _nav_sql() -> str:
    def at(anchor: str) -> str:
        return f"arg_max(equity, trade_date) FILTER (trade_date <= {anchor})"

    cells = [f"{r(f'{at("latest")} / {at(q)} - 1')} AS {q}" for q in _QUOTED]
    return f"SELECT portfolio_id, {', '.join(cells)} FROM nav, anchor_dates GROUP BY portfolio_id"


@query("a7_nav_period_returns", statement(_nav_sql()))
def nav_period_returns(spark, root):
    anchors = R.review_anchors(V.bars(spark, root))
    return round_columns(R.nav_period_returns(V.nav(spark, root), anchors), *PERIODS)


@query("j11_asof_anchors", statement(
    'SELECT latest, "今年", "本月", "本周", "当天" FROM anchor_dates'))
def asof_anchors(spark, root):
    return R.review_anchors(V.bars(spark, root))


@query("a8_correlation", statement(
    f"""SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, {r('corr(a.ret, b.ret)', 7)} AS corr
        FROM ret1 a JOIN ret1 b ON a.trade_date = b.trade_date AND a.symbol <= b.symbol
        GROUP BY 1, 2 HAVING count(*) > 0""",
    ret1="""SELECT p.symbol, p.trade_date, p.close / q.close - 1 AS ret FROM panel p
            JOIN panel q ON q.symbol = p.symbol AND q.date_idx = p.date_idx - 1"""))
def correlation(spark, root):
    return round_columns(return_correlation(V.bars(spark, root), V.master(spark, root)), "corr", digits=7)


def _panel(spark, root):
    return P.with_date_idx(V.bars(spark, root).select("symbol", "trade_date", "open", "close"))


@query("f1_panel_returns", statement(
    f"""SELECT p.symbol, p.trade_date, {r('p.close / a.close - 1')} AS ret_1,
          {r('p.close / b.close - 1')} AS ret_20
        FROM panel p LEFT JOIN panel a ON a.symbol = p.symbol AND a.date_idx = p.date_idx - 1
        LEFT JOIN panel b ON b.symbol = p.symbol AND b.date_idx = p.date_idx - 20"""))
def panel_returns(spark, root):
    w = P.series()
    return _panel(spark, root).select(
        "symbol", "trade_date",
        rounded(P.panel_return("close", 1, w)).alias("ret_1"),
        rounded(P.panel_return("close", 20, w)).alias("ret_20"),
    )


@query("f2_mean_momentum", statement(
    f"""SELECT p.symbol, p.trade_date,
          {r('((p.close / a.close - 1) + (p.close / b.close - 1)) / 2')} AS score
        FROM panel p LEFT JOIN panel a ON a.symbol = p.symbol AND a.date_idx = p.date_idx - 20
        LEFT JOIN panel b ON b.symbol = p.symbol AND b.date_idx = p.date_idx - 60"""))
def mean_momentum(spark, root):
    score = P.mean_return("close", [20, 60], P.series())
    return _panel(spark, root).select("symbol", "trade_date", rounded(score).alias("score"))


_SMA_SQL = """CASE WHEN count(close) OVER w = {n} THEN avg(close) OVER w END"""
_SMA_WINDOW = """WINDOW w AS (PARTITION BY symbol ORDER BY date_idx
                 RANGE BETWEEN {m} PRECEDING AND CURRENT ROW)"""


@query("f3_moving_average", statement(
    f"""SELECT symbol, trade_date, {r(_SMA_SQL.format(n=5), 6)} AS sma FROM panel
        {_SMA_WINDOW.format(m=4)}"""))
def moving_average(spark, root):
    return _panel(spark, root).select(
        "symbol", "trade_date", rounded(P.moving_average("close", 5, P.series()), 6).alias("sma"))


# Minute series are long; positions are whole minutes since 1970. Small blocks, so that the series span many.
_MINUTE_BLOCK = 2_000


def _minute_panel(spark, root):
    bars = V.minute_bars(spark, root).select("symbol", "bar_time", "close", "volume")
    minute = (F.unix_date(F.col("bar_time").cast("date")).cast("bigint") * 1440
              + F.hour("bar_time") * 60 + F.minute("bar_time"))
    return bars.withColumn("minute", minute)


_MINUTE_POSITION = "CAST(epoch(bar_time) / 60 AS BIGINT)"


@query("f3_minute_average", statement(
    f"""SELECT symbol, bar_time, {r('avg(close) OVER w', 6)} AS mean_30,
          {r('close / max(close) OVER b - 1')} AS ret_5
        FROM (SELECT *, {_MINUTE_POSITION} AS pos FROM minute_bars)
        WINDOW w AS (PARTITION BY symbol ORDER BY pos RANGE BETWEEN 29 PRECEDING AND CURRENT ROW),
          b AS (PARTITION BY symbol ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 PRECEDING)"""))
def minute_average(spark, root):
    rated = P.in_blocks(_minute_panel(spark, root), {
        "mean_30": lambda w: F.avg("close").over(w.rangeBetween(-29, 0)),
        "ret_5": lambda w: P.panel_return("close", 5, w),
    }, span=29, order="minute", block=_MINUTE_BLOCK)
    return rated.select("symbol", "bar_time", rounded("mean_30", 6).alias("mean_30"), rounded("ret_5").alias("ret_5"))


@query("f10_minute_mark", statement(
    f"""SELECT symbol, bar_time, last_value(CASE WHEN volume > 1 THEN close END IGNORE NULLS) OVER
          (PARTITION BY symbol ORDER BY bar_time) AS mark FROM minute_bars"""))
def minute_mark(spark, root):
    busy = _minute_panel(spark, root).withColumn("busy_close", F.when(F.col("volume") > 1, F.col("close")))
    marked = P.fill_in_blocks(busy, "busy_close", "mark", order="minute", block=_MINUTE_BLOCK)
    return marked.select("symbol", "bar_time", "mark")


@query("f4_price_bias", statement(
    f"""SELECT symbol, trade_date, {r('close / sma - 1')} AS bias FROM
        (SELECT *, {_SMA_SQL.format(n=5)} AS sma FROM panel {_SMA_WINDOW.format(m=4)})
        WHERE trade_date = (SELECT max(trade_date) FROM bars)"""))
def price_bias(spark, root):
    return round_columns(R.price_bias(V.bars(spark, root), span=5), "bias")


# Closed form of the gap-decaying recursion y' = c*y + (1-c)*x with c = d^k / (d^k + a):
# y_n = prod(c) * (x_0 + sum((1-c_i) x_i / prod_i)).
def ema_ctes(source: str, span: int) -> dict[str, str]:
    a = 2 / (span + 1)
    return {
        "gaps": f"""SELECT *, date_idx - lag(date_idx) OVER (PARTITION BY symbol ORDER BY date_idx)
                    AS gap FROM {source}""",
        "coefs": f"""SELECT *, CASE WHEN gap IS NULL THEN 1.0::DOUBLE
                     ELSE pow({1 - a!r}, gap) / (pow({1 - a!r}, gap) + {a!r}) END AS c FROM gaps""",
        "prods": """SELECT *, exp(sum(ln(c)) OVER (PARTITION BY symbol ORDER BY date_idx)) AS pr
                    FROM coefs""",
        "emas": """SELECT *, pr * sum(CASE WHEN gap IS NULL THEN close ELSE (1 - c) * close / pr
                   END) OVER (PARTITION BY symbol ORDER BY date_idx) AS ema FROM prods""",
        "biases": "SELECT *, (ln(close) - ln(ema)) * 100 AS logbias FROM emas",
    }


@query("f5_ema_logbias", statement(
    f"SELECT symbol, trade_date, {r('ema', 4)} AS ema, {r('logbias', 6)} AS logbias FROM biases",
    **ema_ctes("panel", 20)))
def ema_logbias(spark, root):
    frame = P.with_ema(_panel(spark, root).select("symbol", "trade_date", "date_idx", "close"),
                       "close", 20)
    return frame.select("symbol", "trade_date", rounded("ema", 4).alias("ema"),
                        rounded(log_bias(F.col("close"), F.col("ema")), 6).alias("logbias"))


@query("k8_logbias_table", statement(
    f"""SELECT symbol, trade_date, CAST(last_idx - date_idx AS INT) AS days_back,
          {r('logbias', 6)} AS logbias FROM biases, (SELECT max(date_idx) AS last_idx FROM axis)
        WHERE date_idx > last_idx - 10""", **ema_ctes("panel", 20)))
def logbias_table(spark, root):
    frame = P.with_ema(_panel(spark, root).select("symbol", "trade_date", "date_idx", "close"),
                       "close", 20)
    frame = frame.withColumn("logbias", log_bias(F.col("close"), F.col("ema")))
    return round_columns(R.log_bias_table(frame, 10), "logbias", digits=6)


@query("f6_drawdown", statement(
    f"""SELECT portfolio_id, trade_date, {r('equity / max(equity) OVER (PARTITION BY portfolio_id'
        ' ORDER BY trade_date) - 1')} AS drawdown FROM nav"""))
def drawdown(spark, root):
    w = P.series("portfolio_id", "trade_date")
    return V.nav(spark, root).select(
        "portfolio_id", "trade_date", rounded(P.drawdown("equity", w)).alias("drawdown"))


_CAP_PANEL = """SELECT b.symbol, b.trade_date, b.close, m.total_mv, a.date_idx FROM stock_bars b
    JOIN saxis a USING (trade_date) LEFT JOIN basic m USING (symbol, trade_date)"""
_SAXIS = """SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INT) AS date_idx
    FROM (SELECT DISTINCT trade_date FROM stock_bars)"""


def cap_panel(spark, root):
    stocks = V.bars(spark, root).where(F.col("asset_type") == "stock")
    joined = stocks.select("symbol", "trade_date", "close").join(
        V.basic(spark, root), ["symbol", "trade_date"], "left")
    return P.with_date_idx(joined, P.date_axis(stocks))


@query("f7_previous_market_cap", statement(
    """SELECT p.symbol, p.trade_date, q.total_mv AS previous_mv FROM caps p
       LEFT JOIN caps q ON q.symbol = p.symbol AND q.date_idx = p.date_idx - 1""",
    saxis=_SAXIS, caps=_CAP_PANEL))
def previous_market_cap(spark, root):
    return cap_panel(spark, root).select(
        "symbol", "trade_date", P.lag_by("total_mv", 1, P.series()).alias("previous_mv"))


@query("f8_lookback_price", statement(
    f"""SELECT p.symbol, p.trade_date, q.close AS base_close, {r('p.close / q.close - 1')} AS
          momentum FROM panel p JOIN panel q ON q.symbol = p.symbol
          AND q.date_idx = p.date_idx - 120"""))
def lookback_price(spark, root):
    w = P.series()
    return (
        _panel(spark, root)
        .withColumn("base_close", P.lag_by("close", 120, w))
        .where(F.col("base_close").isNotNull())
        .select("symbol", "trade_date", "base_close",
                rounded(F.col("close") / F.col("base_close") - 1).alias("momentum"))
    )


@query("f9_percent_rank", statement(
    f"""SELECT symbol, trade_date, {r('''(rank() OVER (PARTITION BY trade_date ORDER BY volume)
          + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0)
          / count(*) OVER (PARTITION BY trade_date) * 100''')} AS rps FROM bars"""))
def percent_rank(spark, root):
    ranked = with_percent_rank(V.bars(spark, root).select("symbol", "trade_date", "volume"),
                               "trade_date", "volume", "share")
    return ranked.select("symbol", "trade_date", rounded(F.col("share") * 100).alias("rps"))


@query("f10_forward_filled_mark", statement(
    """SELECT g.symbol, g.trade_date, last_value(coalesce(b.close, b.open) IGNORE NULLS) OVER
         (PARTITION BY g.symbol ORDER BY g.trade_date) AS mark
       FROM (SELECT symbol, trade_date FROM (SELECT DISTINCT symbol FROM bars), axis) g
       LEFT JOIN bars b USING (symbol, trade_date)"""))
def forward_filled_mark(spark, root):
    dense = P.densify(V.bars(spark, root).select("symbol", "trade_date", "open", "close"))
    mark = P.forward_fill(F.coalesce("close", "open"), P.series())
    return dense.select("symbol", "trade_date", mark.alias("mark"))


@query("j14_dates_by_symbols_grid", statement(
    """SELECT symbol, trade_date, date_idx, close FROM (SELECT DISTINCT symbol FROM bars)
       CROSS JOIN axis LEFT JOIN bars USING (symbol, trade_date)"""))
def dates_by_symbols_grid(spark, root):
    dense = P.densify(V.bars(spark, root).select("symbol", "trade_date", "close"))
    return dense.select("symbol", "trade_date", "date_idx", "close")


@query("f11_keep_newest", statement(
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC,
           l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
       WHERE rn = 1"""))
def keep_newest(spark, root):
    lines = V.table(spark, root, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return P.keep_newest(
        lines, ["l_partkey", "l_suppkey"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"],
    ).drop("l_shipdate")


def _starts(unit_sql: str) -> str:
    return f"""row_number() OVER (PARTITION BY {unit_sql} ORDER BY trade_date) = 1"""


@query("f12_rebalance_flags", statement(
    f"""SELECT trade_date, {_starts("date_trunc('week', trade_date + 2)")} AS week_fri,
          {_starts("date_trunc('week', trade_date)")} AS week,
          {_starts("date_trunc('month', trade_date)")} AS month FROM axis"""))
def rebalance_flags(spark, root):
    axis = P.date_axis(V.bars(spark, root))
    flags = axis.select("trade_date")
    for unit in ("week_fri", "week", "month"):
        marked = P.with_period_start(axis, unit).select(
            "trade_date", F.col("is_start").alias(unit))
        flags = flags.join(F.broadcast(marked), "trade_date")
    return flags


@query("n18_period_labels", statement(
    """SELECT trade_date, CAST(date_trunc('week', trade_date + 2) AS DATE) - 2 AS week_fri,
         CAST(date_trunc('week', trade_date) AS DATE) AS week,
         CAST(date_trunc('month', trade_date) AS DATE) AS month, last_day(trade_date) AS month_end,
         make_date(year(trade_date), 12, 31) AS year_end FROM axis"""))
def period_labels(spark, root):
    from barloom.functions.normalize import period_end

    day = F.col("trade_date")
    return P.date_axis(V.bars(spark, root)).select(
        "trade_date", period_key(day, "week_fri").alias("week_fri"),
        period_key(day, "week").alias("week"), period_key(day, "month").alias("month"),
        period_end(day, "month").alias("month_end"), period_end(day, "year").alias("year_end"))


@query("f13_carry_weights", statement(
    """SELECT p.symbol, x.trade_date, p.rank FROM
         (SELECT *, sum(flag) OVER (ORDER BY trade_date) AS epoch FROM
           (SELECT trade_date, CASE WHEN row_number() OVER (PARTITION BY
              date_trunc('month', trade_date) ORDER BY trade_date) = 1 THEN 1 ELSE 0 END AS flag
            FROM axis)) x
       JOIN (SELECT symbol, rank, epoch FROM (SELECT b.symbol, y.epoch, row_number() OVER
               (PARTITION BY b.trade_date ORDER BY b.amount DESC, b.symbol) AS rank
             FROM bars b JOIN (SELECT min(trade_date) AS trade_date,
               row_number() OVER (ORDER BY min(trade_date)) AS epoch FROM axis
               GROUP BY date_trunc('month', trade_date)) y USING (trade_date)) WHERE rank <= 3) p
         USING (epoch)"""))
def carry_weights(spark, root):
    bars = V.bars(spark, root).select("symbol", "trade_date", "amount")
    epochs = P.with_period_start(P.date_axis(bars), "month")
    starts = epochs.where("is_start").select("trade_date", "epoch")
    picks = P.top_k(bars.join(F.broadcast(starts), "trade_date"), ["trade_date"],
                    [F.col("amount").desc(), F.col("symbol")], 3)
    carried = P.carry_to_dates(picks.select("symbol", "rank", "epoch"), epochs)
    return carried.select("symbol", "trade_date", F.col("rank").cast("bigint").alias("rank"))


@query("f14_latch", statement(
    """SELECT symbol, trade_date, coalesce(last_value(event IGNORE NULLS) OVER
         (PARTITION BY symbol ORDER BY date_idx), false) AS held FROM
         (SELECT *, CASE WHEN v >= 5 AND v < 15 THEN true WHEN v <= -5 THEN false END AS event
          FROM (SELECT *, (close / open - 1) * 100 AS v FROM panel))"""))
def latch(spark, root):
    v = (F.col("close") / F.col("open") - 1) * 100
    held = P.latch((v >= 5) & (v < 15), v <= -5, P.series())
    return _panel(spark, root).select("symbol", "trade_date", held.alias("held"))


@query("f15_missing_islands", statement(
    """SELECT min(d) AS range_start, max(d) AS range_end, count(*) AS days FROM
         (SELECT d, CAST(d - DATE '1990-01-01' AS INT) - row_number() OVER (ORDER BY d) AS island
          FROM (SELECT CAST(unnest(generate_series((SELECT min(trade_date) FROM bars)::TIMESTAMP,
                  (SELECT max(trade_date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d)
          WHERE d NOT IN (SELECT trade_date FROM bars WHERE symbol = '510004.SH')) GROUP BY island"""))
def missing_islands(spark, root):
    from barloom.operators.snapshots import missing_calendar_ranges

    bars = V.bars(spark, root)
    bounds = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    covered = bars.where(F.col("symbol") == "510004.SH").select(
        F.col("trade_date").alias("cal_date"))
    return missing_calendar_ranges(
        spark, bounds.select("a").scalar(), bounds.select("b").scalar(), covered)


@query("k1_top_score_per_date", statement(
    """SELECT symbol, trade_date, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS weight
       FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol)
             AS rn FROM bars WHERE close > open) WHERE rn <= 3"""))
def top_score_per_date(spark, root):
    from barloom.plans.strategies import equal_weight

    eligible = V.bars(spark, root).where(F.col("close") > F.col("open"))
    best = P.top_k(eligible, ["trade_date"], [F.col("amount").desc(), F.col("symbol")], 3)
    return equal_weight(best.select("symbol", "trade_date"), ["trade_date"]).select(
        "symbol", "trade_date", "weight")


def _smallest(spark, root, k):
    caps = V.basic(spark, root).where(~code_excluded(F.col("symbol")))
    return P.top_k(caps, ["trade_date"], [F.col("total_mv"), F.col("symbol")], k)


_SMALLEST = """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY total_mv, symbol) AS rank
    FROM basic WHERE NOT regexp_matches(symbol, '^(688|8|4)')"""


@query("k2_smallest_caps", statement(
    "SELECT symbol, trade_date, total_mv, rank FROM sm WHERE rank <= 5", sm=_SMALLEST))
def smallest_caps(spark, root):
    return _smallest(spark, root, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("k3_rank_slice", statement(
    "SELECT symbol, trade_date, rank FROM sm WHERE rank BETWEEN 3 AND 6", sm=_SMALLEST))
def rank_slice(spark, root):
    return _smallest(spark, root, 6).where(F.col("rank") >= 3).select(
        "symbol", "trade_date", F.col("rank").cast("bigint").alias("rank"))


@query("k7_last_dates", statement(
    """SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date DESC) AS BIGINT) AS back
       FROM axis QUALIFY row_number() OVER (ORDER BY trade_date DESC) <= 10"""))
def last_dates(spark, root):
    from barloom.operators.snapshots import last_dates as pick

    return pick(V.bars(spark, root).select("trade_date"), 10)
