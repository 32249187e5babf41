"""Catalogue: strategies, signal gates, portfolio accounting and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.constants import METRIC_LABELS
from barloom.operators import panel as P, performance as Perf, portfolio as Port, quality as Q
from barloom.plans import driver_views as V, strategies as S
from barloom.plans.catalogue import query, round_columns, rounded
from barloom.plans.oracle_views import r, statement
from barloom.plans.queries_panel import ema_ctes
from barloom.session import cut


def etf_bars(spark, root):
    return V.bars(spark, root).where(F.col("asset_type") == "etf")


def stock_caps(spark, root):
    stocks = V.bars(spark, root).where(F.col("asset_type") == "stock")
    return stocks.select("symbol", "trade_date", "open", "close").join(
        V.basic(spark, root), ["symbol", "trade_date"], "left")


# ---- reference SQL of the strategies ------------------------------------------------------------
_ETF = {
    "scored": """SELECT p.*, ((p.close / a.close - 1) + (p.close / b.close - 1)) / 2 AS score,
        CASE WHEN count(p.close) OVER w = 3 THEN avg(p.close) OVER w END AS ma
      FROM etf_panel p
      LEFT JOIN etf_panel a ON a.symbol = p.symbol AND a.date_idx = p.date_idx - 2
      LEFT JOIN etf_panel b ON b.symbol = p.symbol AND b.date_idx = p.date_idx - 5
      WINDOW w AS (PARTITION BY p.symbol ORDER BY p.date_idx
                   RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "starts": """SELECT min(trade_date) AS start_date,
        lead(min(trade_date)) OVER (ORDER BY min(trade_date)) AS next_date
      FROM etf_axis GROUP BY date_trunc('week', trade_date + 2)""",
    "picks": """SELECT s.start_date, s.next_date, c.symbol, row_number() OVER
        (PARTITION BY s.start_date ORDER BY c.score DESC, c.symbol) AS rn
      FROM starts s JOIN scored c ON c.trade_date = s.start_date
      WHERE c.score > 0 AND c.close > c.ma""",
    "etf_weights": """SELECT p.symbol, x.trade_date, 1.0::DOUBLE / count(*) OVER
        (PARTITION BY x.trade_date) AS weight
      FROM picks p JOIN etf_axis x ON x.trade_date >= p.start_date
        AND (p.next_date IS NULL OR x.trade_date < p.next_date) WHERE p.rn <= 2""",
}
_ETF_PARAMS = {"momentum_windows": (2, 5), "ma_window": 3, "hold_num": 2, "rebalance_days": 5}


@query("c3_etf_rotation", statement(
    "SELECT symbol, trade_date, weight FROM etf_weights", **_ETF))
def etf_rotation(spark, root):
    return S.etf_rotation(etf_bars(spark, root), **_ETF_PARAMS)


_LOGBIAS = {
    **ema_ctes("etf_panel", 20),
    "events": """SELECT *, lead(date_idx) OVER (PARTITION BY symbol ORDER BY date_idx) AS next_idx,
        last_value(CASE WHEN logbias >= 5 AND logbias < 15 THEN true WHEN logbias <= -5 THEN false
          END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date_idx) AS held FROM biases""",
    "logbias_weights": """SELECT e.symbol, x.trade_date,
        1.0::DOUBLE / count(*) OVER (PARTITION BY x.trade_date) AS weight
      FROM events e JOIN etf_axis x ON x.date_idx >= e.date_idx
        AND (e.next_idx IS NULL OR x.date_idx < e.next_idx) WHERE e.held""",
}


@query("c4_logbias", statement(
    "SELECT symbol, trade_date, weight FROM logbias_weights", **_LOGBIAS))
def logbias(spark, root):
    return S.logbias(etf_bars(spark, root))


def _microcap(selection_sql: str, period: str, lookback: int = 60) -> dict[str, str]:
    return {
        "saxis": """SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INT)
            AS date_idx FROM (SELECT DISTINCT trade_date FROM stock_bars)""",
        "caps": """SELECT b.symbol, b.trade_date, b.close, m.total_mv, a.date_idx
            FROM stock_bars b JOIN saxis a USING (trade_date)
            LEFT JOIN basic m USING (symbol, trade_date)""",
        "mstarts": f"""SELECT min(trade_date) AS start_date,
            lead(min(trade_date)) OVER (ORDER BY min(trade_date)) AS next_date
            FROM saxis GROUP BY date_trunc('{period}', trade_date)""",
        "pool": f"""SELECT * FROM (SELECT c.symbol, s.start_date, s.next_date, c.date_idx,
              c.close / z.close - 1 AS momentum, row_number() OVER (PARTITION BY c.trade_date
                ORDER BY q.total_mv, c.symbol) AS pool_rank
            FROM mstarts s JOIN caps c ON c.trade_date = s.start_date
            JOIN caps q ON q.symbol = c.symbol AND q.date_idx = c.date_idx - 1
            LEFT JOIN caps z ON z.symbol = c.symbol AND z.date_idx = c.date_idx - {lookback}
            WHERE q.total_mv IS NOT NULL AND NOT regexp_matches(c.symbol, '^(688|8|4)'))
            WHERE pool_rank <= 8""",
        "picked": selection_sql,
        "mweights": """SELECT p.symbol, x.trade_date, 1.0::DOUBLE / count(*) OVER
              (PARTITION BY x.trade_date) AS weight
            FROM picked p JOIN saxis x ON x.trade_date >= p.start_date
              AND (p.next_date IS NULL OR x.trade_date < p.next_date)""",
    }


_RPS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_date
      ORDER BY abs(rps - 70) NULLS LAST, pool_rank) AS pick FROM (
    SELECT *, CASE WHEN momentum IS NOT NULL THEN (rank() OVER (PARTITION BY start_date
          ORDER BY momentum NULLS LAST) + (count(momentum) OVER (PARTITION BY start_date, momentum)
          - 1) / 2.0) / count(momentum) OVER (PARTITION BY start_date) * 100 END AS rps
    FROM pool WHERE date_idx >= 60)) WHERE pick <= 3"""
_MODES = {
    "pool": ("weekly", "week", "SELECT * FROM pool", {}),
    "rank": ("monthly", "month", "SELECT * FROM pool WHERE pool_rank BETWEEN 3 AND 5",
             {"hold_count": 3, "rank_start": 3}),
    "smallest": ("daily", "day", "SELECT * FROM pool WHERE pool_rank <= 3", {"hold_count": 3}),
    "rps": ("weekly", "week", _RPS, {"hold_count": 3, "rps_lookback_days": 60}),
}


def _register_microcap(mode: str) -> None:
    rebalance, period, selection, params = _MODES[mode]

    def run(spark, root):
        return S.microcap(stock_caps(spark, root), pool_size=8, selection=mode,
                          rebalance=rebalance, **params)

    query(f"c5_microcap_{mode}", statement(
        "SELECT symbol, trade_date, weight FROM mweights", **_microcap(selection, period)))(run)


for _mode in _MODES:
    _register_microcap(_mode)


@query("k4_closest_to_target_rps", statement(
    "SELECT symbol, start_date AS trade_date, pick FROM picked", **_microcap(_RPS, "week")))
def closest_to_target_rps(spark, root):
    bars = stock_caps(spark, root)
    axis = P.with_period_start(P.date_axis(bars), "week")
    pool = S.smallest_pool(S.rebalance_caps(bars, axis, 60), ("688", "8", "4"), 8)
    best = S.closest_to_rps(pool, 60, 70, 3)
    return best.select("symbol", "trade_date", F.col("rank").cast("bigint").alias("pick"))


@query("k5_smallest_of_pool", statement(
    "SELECT symbol, start_date AS trade_date, pool_rank FROM pool WHERE pool_rank <= 3",
    **_microcap("SELECT 1", "month")))
def smallest_of_pool(spark, root):
    bars = stock_caps(spark, root)
    axis = P.with_period_start(P.date_axis(bars), "month")
    pool = S.smallest_pool(S.rebalance_caps(bars, axis, 1), ("688", "8", "4"), 3)
    return pool.select("symbol", "trade_date", F.col("pool_rank").cast("bigint").alias("pool_rank"))


@query("c6_latest_signal", statement(
    """SELECT (SELECT max(trade_date) FROM etf_bars) AS as_of, count(*) AS holdings,
         coalesce(string_agg(printf('%s %.1f%%', symbol, weight * 100), '、' ORDER BY symbol),
           '空仓') AS summary
       FROM etf_weights WHERE trade_date = (SELECT max(trade_date) FROM etf_bars)""", **_ETF))
def latest_signal(spark, root):
    bars = etf_bars(spark, root)
    return S.latest_signal(bars, S.etf_rotation(bars, **_ETF_PARAMS))


@query("k6_etf_diagnostics", statement(
    f"""SELECT s.symbol, s.close, {r('s.score')} AS momentum_score,
          coalesce(s.score > 0 AND s.close > s.ma, false) AS eligible,
          coalesce(w.weight, 0.0) AS target_weight
        FROM scored s LEFT JOIN etf_weights w USING (symbol, trade_date)
        WHERE s.trade_date = (SELECT max(trade_date) FROM etf_bars)""", **_ETF))
def etf_diagnostics(spark, root):
    bars = etf_bars(spark, root)
    table = S.etf_diagnostics(bars, S.etf_rotation(bars, **_ETF_PARAMS), (2, 5), 3)
    return round_columns(table, "momentum_score")


@query("k6_logbias_diagnostics", statement(
    f"""SELECT b.symbol, b.close, {r('b.logbias', 6)} AS logbias,
          coalesce(w.weight, 0.0) AS target_weight
        FROM biases b LEFT JOIN logbias_weights w USING (symbol, trade_date)
        WHERE b.trade_date = (SELECT max(trade_date) FROM etf_bars)""", **_LOGBIAS))
def logbias_diagnostics(spark, root):
    bars = etf_bars(spark, root)
    return round_columns(S.log_bias_diagnostics(bars, S.logbias(bars)), "logbias", digits=6)


@query("c7_signal_gate", statement(
    """SELECT t.asked, u.symbol, count(DISTINCT b.trade_date) AS dates,
         coalesce(bool_or(b.trade_date = t.day), false) AS fresh, count(DISTINCT b.trade_date) >= 61 AS warm
       FROM (SELECT DISTINCT symbol FROM etf_bars) u CROSS JOIN (
         SELECT 'latest' AS asked, (SELECT max(trade_date) FROM etf_bars) AS day
         UNION ALL SELECT 'middle', DATE '1995-03-15' UNION ALL SELECT 'behind', DATE '2024-01-02') t
       LEFT JOIN etf_bars b ON b.symbol = u.symbol AND b.trade_date <= t.day GROUP BY t.asked, u.symbol"""))
def signal_gate(spark, root):
    from barloom.plans.gates import signal_gate as gate

    bars = etf_bars(spark, root)
    universe = bars.select("symbol").distinct()
    need = S.warmup_bars("etf_rotation", momentum_windows=(20, 60))
    asked = {"latest": None, "middle": F.lit("1995-03-15").cast("date"), "behind": F.lit("2024-01-02").cast("date")}
    parts = [gate(bars, universe, need, day).withColumn("asked", F.lit(name)) for name, day in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("v18_short_history", statement(
    """SELECT u.symbol, count(DISTINCT b.trade_date) AS dates FROM (SELECT DISTINCT symbol
         FROM bars) u LEFT JOIN bars b ON b.symbol = u.symbol AND b.trade_date < DATE '1995-06-01'
       GROUP BY u.symbol HAVING count(DISTINCT b.trade_date) < 105"""))
def short_history(spark, root):
    bars = V.bars(spark, root)
    return Q.short_history(bars, bars, 105, F.lit("1995-06-01").cast("date"))


@query("v19_stale_symbols", statement(
    """SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN
         (SELECT symbol FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars))"""))
def stale_symbols(spark, root):
    bars = V.bars(spark, root)
    return Q.stale_symbols(bars, bars, bars.agg(F.max("trade_date")).scalar())


# ---- portfolio accounting ----------------------------------------------------------------------
def targets(spark, root):
    """Two portfolios over the ETF bars: weekly rotation and the log-bias latch."""
    bars = etf_bars(spark, root)
    rotation = S.etf_rotation(bars, **_ETF_PARAMS).withColumn("portfolio_id", F.lit("rotation"))
    latch = S.logbias(bars).withColumn("portfolio_id", F.lit("logbias"))
    weights = cut(rotation.unionByName(latch).withColumnRenamed("trade_date", "signal_date"))
    days = S.signal_dates(bars).select(F.col("trade_date").alias("signal_date"))
    names = F.explode(F.array(F.lit("rotation"), F.lit("logbias"))).alias("portfolio_id")
    return bars, weights, days.select(names, "signal_date")


_TARGETS = {
    **{k: v for k, v in _LOGBIAS.items()}, **_ETF,
    "targets": """SELECT 'rotation' AS pid, symbol, trade_date AS d, weight FROM etf_weights
        UNION ALL SELECT 'logbias', symbol, trade_date, weight FROM logbias_weights""",
    # effective weights per bar date: the target of the previous bar date
    "eff": """SELECT t.pid, t.symbol, n.trade_date, n.date_idx, t.weight, t.d AS signal_date
        FROM targets t JOIN etf_axis s ON s.trade_date = t.d
        JOIN etf_axis n ON n.date_idx = s.date_idx + 1""",
    "pdays": """SELECT pid, date_idx, trade_date FROM (SELECT unnest(['rotation', 'logbias'])
        AS pid) CROSS JOIN etf_axis WHERE date_idx >= 1""",
    "vec": """SELECT p.pid, p.date_idx, p.trade_date, coalesce(string_agg(e.symbol || ':' ||
          e.weight, ',' ORDER BY e.symbol), '') AS vector FROM pdays p LEFT JOIN eff e
        ON e.pid = p.pid AND e.date_idx = p.date_idx GROUP BY ALL""",
    "turns": """SELECT *, lead(date_idx) OVER (PARTITION BY pid ORDER BY date_idx) AS next_idx,
          row_number() OVER (PARTITION BY pid ORDER BY date_idx) AS epoch
        FROM (SELECT *, lag(vector) OVER (PARTITION BY pid ORDER BY date_idx) AS pv FROM vec)
        WHERE pv IS NULL OR pv <> vector""",
    "hold": """SELECT t.pid, t.epoch, t.date_idx AS start_idx, t.next_idx,
          coalesce(t.next_idx, (SELECT max(date_idx) + 1 FROM etf_axis)) AS end_idx,
          e.symbol, e.weight, e.signal_date
        FROM turns t JOIN eff e ON e.pid = t.pid AND e.date_idx = t.date_idx""",
    "dense": """SELECT g.symbol, g.date_idx, b.open, last_value(coalesce(b.close, b.open)
          IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date_idx) AS mark,
          last_value(coalesce(b.close, b.open) IGNORE NULLS) OVER (PARTITION BY g.symbol
          ORDER BY g.date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pmark
        FROM (SELECT symbol, date_idx FROM (SELECT DISTINCT symbol FROM etf_bars)
              CROSS JOIN etf_axis) g LEFT JOIN etf_panel b USING (symbol, date_idx)""",
    "filled": """SELECT h.*, f.date_idx AS fill_idx, f.open AS fill_open FROM hold h
        ASOF LEFT JOIN (SELECT * FROM dense WHERE open > 0) f
        ON f.symbol = h.symbol AND f.date_idx >= h.start_idx""",
    "fills": """SELECT * REPLACE (CASE WHEN fill_idx < end_idx THEN fill_idx END AS fill_idx)
        FROM filled""",
    "leaving": """SELECT f.pid, f.epoch, f.symbol, f.weight, f.fill_idx,
          CASE WHEN f.fill_idx IS NULL THEN 1.0 ELSE coalesce(d.open, d.pmark) / f.fill_open END
            AS growth
        FROM fills f JOIN dense d ON d.symbol = f.symbol AND d.date_idx = f.next_idx""",
    "drift": """SELECT t.pid, t.epoch, 1 + coalesce(sum(l.weight * (l.growth - 1)), 0) AS drift
        FROM turns t LEFT JOIN leaving l USING (pid, epoch) GROUP BY ALL""",
    "moves": """SELECT pid, epoch, sum(abs(move)) AS turnover, sum(greatest(-move, 0)) AS sold
        FROM (SELECT pid, epoch, symbol, sum(w) AS move FROM (
          SELECT pid, epoch, symbol, weight AS w FROM hold UNION ALL
          SELECT l.pid, l.epoch + 1, l.symbol, -l.weight * l.growth / d.drift
          FROM leaving l JOIN drift d USING (pid, epoch) WHERE l.fill_idx IS NOT NULL)
          GROUP BY ALL) GROUP BY ALL""",
    "ledger": """SELECT *, sum(ln(carried * (1 - cost))) OVER (PARTITION BY pid ORDER BY epoch)
          AS log_start FROM (
        SELECT t.*, coalesce(m.turnover, 0) AS turnover,
          0.00045 * coalesce(m.turnover, 0) + 0.0005 * coalesce(m.sold, 0) AS cost,
          coalesce(lag(d.drift) OVER (PARTITION BY t.pid ORDER BY t.epoch), 1.0) AS carried
        FROM turns t LEFT JOIN moves m USING (pid, epoch) LEFT JOIN drift d USING (pid, epoch))""",
    "valued": """SELECT f.pid, f.epoch, d.date_idx, f.symbol, f.weight,
          d.date_idx >= f.fill_idx AS live,
          CASE WHEN d.date_idx >= f.fill_idx THEN f.weight * d.mark / f.fill_open
               ELSE f.weight END AS value
        FROM fills f JOIN dense d ON d.symbol = f.symbol AND d.date_idx >= f.start_idx
          AND d.date_idx < f.end_idx""",
    "levels": """SELECT pid, epoch, date_idx, 1 + sum(value - weight) AS level FROM valued
        GROUP BY ALL""",
    "equities": """SELECT l.pid, x.trade_date, x.date_idx, l.log_start + ln(coalesce(v.level, 1))
          AS log_equity
        FROM ledger l JOIN etf_axis x ON x.date_idx >= l.date_idx
          AND (l.next_idx IS NULL OR x.date_idx < l.next_idx)
        LEFT JOIN levels v ON v.pid = l.pid AND v.epoch = l.epoch AND v.date_idx = x.date_idx
        UNION ALL SELECT pid, (SELECT min(trade_date) FROM etf_axis), 0, 0.0
        FROM (SELECT DISTINCT pid FROM pdays)""",
}


@query("c10_portfolio_equity", statement(
    f"""SELECT pid AS portfolio_id, trade_date, {r('log_equity', 6)} AS log_growth
        FROM equities""", **_TARGETS))
def portfolio_equity(spark, root):
    equity = Port.account(*targets(spark, root)).equity
    return equity.select("portfolio_id", "trade_date",
                         rounded(F.log(F.col("equity") / 1_000_000.0), 6).alias("log_growth"))


@query("c10_portfolio_positions", statement(
    f"""SELECT pid AS portfolio_id, x.trade_date, symbol, {r('value / level', 6)} AS weight
        FROM valued v JOIN levels l USING (pid, epoch, date_idx)
        JOIN etf_axis x USING (date_idx) WHERE live""", **_TARGETS))
def portfolio_positions(spark, root):
    positions = Port.account(*targets(spark, root)).positions
    return round_columns(positions, "weight", digits=6)


@query("c10_portfolio_epochs", statement(
    f"""SELECT pid AS portfolio_id, CAST(epoch AS INT) AS epoch, trade_date AS start_date,
          {r('turnover', 6)} AS turnover, {r('cost', 8)} AS cost FROM ledger""", **_TARGETS))
def portfolio_epochs(spark, root):
    epochs = Port.account(*targets(spark, root)).epochs
    return epochs.select("portfolio_id", "epoch", "start_date",
                         rounded("turnover", 6).alias("turnover"), rounded("cost").alias("cost"))


@query("c11_fill_table", statement(
    f"""SELECT o.pid AS portfolio_id, s.trade_date AS signal_date, o.symbol,
          CASE WHEN new > old THEN 'BUY' ELSE 'SELL' END AS side,
          x.trade_date AS fill_date, {r('''CASE WHEN x.trade_date IS NOT NULL THEN f.open *
            (CASE WHEN new > old THEN 1.0002 ELSE 0.9998 END) END''', 6)} AS fill_price
        FROM (SELECT pid, epoch, symbol, sum(n) AS new, sum(o) AS old FROM (
            SELECT pid, epoch, symbol, weight AS n, 0 AS o FROM hold UNION ALL
            SELECT pid, epoch + 1, symbol, 0, weight FROM hold WHERE next_idx IS NOT NULL)
          GROUP BY ALL HAVING sum(n) <> sum(o)) o
        JOIN turns t USING (pid, epoch) JOIN etf_axis s ON s.date_idx = t.date_idx - 1
        ASOF LEFT JOIN (SELECT * FROM dense WHERE open > 0) f
          ON f.symbol = o.symbol AND f.date_idx >= t.date_idx
        LEFT JOIN etf_axis x ON x.date_idx = f.date_idx
          AND (t.next_idx IS NULL OR f.date_idx < t.next_idx)""", **_TARGETS))
def fill_table(spark, root):
    fills = Port.fill_table(*targets(spark, root)).drop("delayed")
    return round_columns(fills, "fill_price", digits=6)


@query("c9_backtest_frame", statement(
    """SELECT pid AS portfolio_id, min(d) AS first_signal, count(*) AS rows FROM targets t
       WHERE d >= (SELECT coalesce(max(trade_date), DATE '1998-01-01') FROM etf_axis
                   WHERE trade_date < DATE '1998-01-01') GROUP BY pid""", **_TARGETS))
def backtest_frame(spark, root):
    _, weights, days = targets(spark, root)
    kept, _ = Port.evaluation_targets(weights, days, "1998-01-01")
    return kept.groupBy("portfolio_id").agg(
        F.min("signal_date").alias("first_signal"), F.count(F.lit(1)).alias("rows"))


@query("j12_strict_asof_targets", statement(
    """SELECT n.trade_date, max(s.trade_date) AS signal_date FROM axis n
       JOIN (SELECT min(trade_date) AS trade_date FROM axis GROUP BY
             date_trunc('month', trade_date)) s ON s.trade_date < n.trade_date
       GROUP BY n.trade_date"""))
def strict_asof_targets(spark, root):
    from barloom.operators.asof import latest_before

    axis = P.with_period_start(P.date_axis(V.bars(spark, root)), "month")
    starts = axis.where("is_start").select(F.col("trade_date").alias("signal_date"))
    return latest_before(axis.select("trade_date"), starts, strict=True)


@query("j13_next_valid_open", statement(
    """SELECT a.symbol, a.trade_date, min(b.trade_date) AS fill_date FROM
         (SELECT symbol, trade_date FROM (SELECT DISTINCT symbol FROM etf_bars)
          CROSS JOIN etf_axis) a
       LEFT JOIN etf_bars b ON b.symbol = a.symbol AND b.trade_date >= a.trade_date
         AND b.open > 5000 GROUP BY ALL"""))
def next_valid_open(spark, root):
    dense = P.densify(etf_bars(spark, root).select("symbol", "trade_date", "open"))
    usable = F.when(F.col("open") > 5000, F.col("trade_date"))
    return dense.select("symbol", "trade_date",
                        P.next_valid(usable, "symbol", include_current=True).alias("fill_date"))


# ---- performance -------------------------------------------------------------------------------
_METRICS = """SELECT portfolio_id, last / first - 1 AS total_return,
      pow(last / first, 1 / years) - 1 AS cagr, sd * sqrt(ann) AS annual_volatility,
      CASE WHEN sd > 0 THEN (mean - (pow(1.015, 1 / ann) - 1)) / sd * sqrt(ann) END AS sharpe,
      max_drawdown, CASE WHEN max_drawdown < 0 THEN
        (pow(last / first, 1 / years) - 1) / abs(max_drawdown) END AS calmar
    FROM (SELECT *, CASE WHEN elapsed > 0 THEN least(252.0, (n - 1) / years) ELSE 252.0 END AS ann
    FROM (SELECT portfolio_id, arg_min(equity, trade_date) AS first,
        arg_max(equity, trade_date) AS last, avg(ret) AS mean, stddev_samp(ret) AS sd,
        min(dd) AS max_drawdown, count(*) AS n, max(trade_date) - min(trade_date) AS elapsed,
        greatest((max(trade_date) - min(trade_date)) / 365.25, 1 / 365.25) AS years
      FROM (SELECT *, equity / lag(equity) OVER w - 1 AS ret, equity / max(equity) OVER w - 1 AS dd
            FROM nav WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date))
      GROUP BY portfolio_id))"""


@query("a11_performance", statement(
    "SELECT portfolio_id, " + ", ".join(f"{r(m, 7)} AS {m}" for m in METRIC_LABELS)
    + " FROM metrics", metrics=_METRICS))
def performance(spark, root):
    metrics = Perf.performance(V.nav(spark, root), risk_free=0.015)
    return round_columns(metrics, *METRIC_LABELS, digits=7)


def _period_returns_sql(unit: str) -> str:
    return f"""SELECT portfolio_id, CAST(p + INTERVAL 1 {unit} AS DATE) - 1 AS period_end,
        eq / coalesce(lag(eq) OVER w, first_eq) - 1 AS ret, p FROM (
      SELECT g.portfolio_id, g.p, last_value(m.eq IGNORE NULLS) OVER v AS eq,
        first_value(m.first_eq) OVER v AS first_eq
      FROM (SELECT portfolio_id, unnest(generate_series(date_trunc('{unit}', min(trade_date)),
              date_trunc('{unit}', max(trade_date)), INTERVAL 1 {unit})) AS p
            FROM nav GROUP BY portfolio_id) g
      LEFT JOIN (SELECT portfolio_id, date_trunc('{unit}', trade_date) AS p,
          arg_max(equity, trade_date) AS eq, arg_min(equity, trade_date) AS first_eq
        FROM nav GROUP BY ALL) m ON m.portfolio_id = g.portfolio_id AND m.p = g.p
      WINDOW v AS (PARTITION BY g.portfolio_id ORDER BY g.p))
      WINDOW w AS (PARTITION BY portfolio_id ORDER BY p)"""


@query("a12_monthly_returns", statement(
    f"SELECT portfolio_id, period_end, {r('ret')} AS ret FROM m",
    m=_period_returns_sql("month")))
def monthly_returns(spark, root):
    return round_columns(Perf.period_equity_returns(V.nav(spark, root), "month"), "ret")


@query("a12_annual_returns", statement(
    f"SELECT portfolio_id, period_end, {r('ret')} AS ret FROM m", m=_period_returns_sql("year")))
def annual_returns(spark, root):
    return round_columns(Perf.period_equity_returns(V.nav(spark, root), "year"), "ret")


@query("a13_monthly_stats", statement(
    f"""SELECT portfolio_id, count(*) FILTER (ret > 0) AS positive,
          count(*) FILTER (ret < 0) AS negative,
          {r('count(*) FILTER (ret > 0) / count(*)')} AS win_rate, {r('avg(ret)')} AS mean,
          {r('max(ret)')} AS best, {r('min(ret)')} AS worst FROM m GROUP BY portfolio_id""",
    m=_period_returns_sql("month")))
def monthly_stats(spark, root):
    stats = Perf.monthly_stats(Perf.period_equity_returns(V.nav(spark, root), "month"))
    return round_columns(stats, "win_rate", "mean", "best", "worst")


def trades(spark, root):
    """Orders as trades: side from the status, costs as rates on the notional."""
    orders = V.table(spark, root, "orders")
    notional = F.col("o_totalprice")
    side = F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY")
    return orders.select(
        F.col("o_orderpriority").alias("portfolio_id"), side.alias("side"),
        notional.alias("notional"), (notional * 0.00025).alias("commission"),
        F.when(side == "SELL", notional * 0.0005).otherwise(F.lit(0.0)).alias("tax"))


@query("a14_trade_summary", statement(
    f"""SELECT t.portfolio_id, orders, buys, sells, {r('notional', 2)} AS notional,
          {r('commission', 2)} AS commission, {r('tax', 2)} AS tax,
          {r('commission + tax', 2)} AS cost, {r('notional / average', 6)} AS turnover
        FROM (SELECT o_orderpriority AS portfolio_id, count(*) AS orders,
            count(*) FILTER (o_orderstatus <> 'F') AS buys,
            count(*) FILTER (o_orderstatus = 'F') AS sells, sum(o_totalprice) AS notional,
            sum(o_totalprice * 0.00025) AS commission,
            sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.0005 ELSE 0 END) AS tax
          FROM orders GROUP BY 1) t
        JOIN (SELECT portfolio_id, avg(equity) AS average FROM nav GROUP BY 1) USING
          (portfolio_id)"""))
def trade_summary(spark, root):
    summary = Perf.trade_summary(trades(spark, root), V.nav(spark, root))
    summary = round_columns(summary, "notional", "commission", "tax", "cost", digits=2)
    return round_columns(summary, "turnover", digits=6)


_BENCH = """SELECT trade_date, max(close) AS close FROM bars GROUP BY trade_date"""


def benchmark(spark, root):
    return V.bars(spark, root).groupBy("trade_date").agg(F.max("close").alias("close"))


_BENCH_EQUITY = """SELECT n.portfolio_id, n.trade_date, b.close /
      first_value(b.close) OVER (PARTITION BY n.portfolio_id ORDER BY n.trade_date) * 1000000
      AS equity FROM nav_in n JOIN bench b USING (trade_date)
    WHERE n.portfolio_id IN (SELECT portfolio_id FROM nav_in LEFT JOIN bench USING (trade_date)
      GROUP BY 1 HAVING count(*) = count(close))"""
_NAV_IN = """SELECT * FROM nav WHERE portfolio_id LIKE '1%' OR trade_date IN
    (SELECT trade_date FROM bars)"""


def covered_nav(spark, root):
    """NAV with one portfolio left on its own dates and the others cut to bar dates."""
    days = V.calendar(spark, root).select(F.col("cal_date").alias("trade_date"))
    nav = V.nav(spark, root)
    own = F.col("portfolio_id").startswith("1")
    return nav.where(own).union(nav.where(~own).join(days, "trade_date", "left_semi").select(
        *nav.columns))


@query("j18_aligned_benchmark", statement(
    f"SELECT portfolio_id, trade_date, {r('equity', 4)} AS equity FROM be",
    bench=_BENCH, nav_in=_NAV_IN, be=_BENCH_EQUITY))
def aligned_benchmark(spark, root):
    aligned = Perf.aligned_benchmark(covered_nav(spark, root), benchmark(spark, root))
    return round_columns(aligned, "equity", digits=4)


@query("j10_benchmark_gaps", statement(
    """SELECT portfolio_id, count(*) AS missing_dates, min(trade_date) AS first_missing FROM nav
       WHERE trade_date NOT IN (SELECT trade_date FROM bars) GROUP BY 1"""))
def benchmark_gaps(spark, root):
    return Perf.benchmark_gaps(V.nav(spark, root), V.bars(spark, root))


def _year_sql(name: str) -> str:
    return f"""SELECT portfolio_id, y, eq / coalesce(lag(eq) OVER (PARTITION BY portfolio_id
      ORDER BY y), fe) - 1 AS ret FROM (SELECT portfolio_id, year(trade_date) AS y,
      arg_max(equity, trade_date) AS eq, arg_min(equity, trade_date) AS fe FROM {name}
      GROUP BY ALL)"""


@query("j19_annual_excess", statement(
    f"""SELECT a.portfolio_id, CAST(a.y AS INT) AS year, {r('a.ret')} AS strategy_return,
          {r('b.ret')} AS benchmark_return, {r('a.ret - b.ret')} AS excess
        FROM own a LEFT JOIN oth b USING (portfolio_id, y)""",
    bench=_BENCH, nav_in=_NAV_IN, be=_BENCH_EQUITY, own=_year_sql("nav_in"), oth=_year_sql("be")))
def annual_excess(spark, root):
    nav = covered_nav(spark, root)
    table = Perf.annual_comparison(nav, Perf.aligned_benchmark(nav, benchmark(spark, root)))
    return round_columns(table, "strategy_return", "benchmark_return", "excess")


def _metric_rows() -> str:
    rows = []
    for i, (name, label) in enumerate(METRIC_LABELS.items()):
        share = name in ("total_return", "cagr", "annual_volatility", "max_drawdown")
        text = f"printf('%.2f%%', {name} * 100)" if share else f"printf('%.2f', {name})"
        rows.append(f"SELECT portfolio_id, {i} AS ordinal, '{label}' AS metric, "
                    f"coalesce({text}, '—') AS strategy, '—' AS benchmark FROM metrics")
    return " UNION ALL ".join(rows)


@query("c12_metric_table", statement(_metric_rows(), metrics=_METRICS))
def metric_table(spark, root):
    return Perf.metric_table(Perf.performance(V.nav(spark, root), risk_free=0.015))
