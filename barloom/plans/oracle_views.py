"""DuckDB text of the derived views, assembled into self-contained statements."""

from __future__ import annotations

import re

VIEWS = {
    "bars": """
      SELECT CASE WHEN k < 2 THEN '688' WHEN k = 2 THEN '830' WHEN k = 3 THEN '430'
                  WHEN k < 8 THEN '510' ELSE '000' END || lpad(CAST(k AS VARCHAR), 3, '0')
             || CASE WHEN k < 2 THEN '.SH' WHEN k < 4 THEN '.BJ' WHEN k < 8 THEN '.SH'
                     ELSE '.SZ' END AS symbol,
             CASE WHEN k BETWEEN 4 AND 7 THEN 'etf' ELSE 'stock' END AS asset_type,
             trade_date,
             first(px ORDER BY l_orderkey, l_linenumber, px) AS open,
             max(px) AS high, min(px) AS low,
             last(px ORDER BY l_orderkey, l_linenumber, px) AS close,
             CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS volume,
             CAST(sum(CAST(px AS DECIMAL(18,2))) AS DOUBLE) AS amount,
             'none' AS adjustment
      FROM (SELECT CAST(l_suppkey % 20 AS INT) AS k, CAST(l_shipdate AS DATE) AS trade_date,
                   l_orderkey, l_linenumber, l_extendedprice AS px, l_quantity AS qty
            FROM lineitem) GROUP BY k, trade_date""",
    "basic": """
      SELECT symbol, trade_date, amount AS total_mv FROM bars
      WHERE asset_type = 'stock' AND NOT (volume = 1 AND symbol LIKE '000%')""",
    "calendar": "SELECT DISTINCT trade_date AS cal_date, 1 AS is_open FROM bars",
    "minute_bars": """
      SELECT symbol, CAST(bar_time AS DATE) AS trade_date, CAST(bar_time AS TIMESTAMP) AS bar_time,
             first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
             last(value ORDER BY ts) AS close, CAST(count(*) AS DOUBLE) AS volume,
             CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
      FROM (SELECT event_type || '.SZ' AS symbol, ts, value,
                   date_trunc('minute', ts) + INTERVAL 1 MINUTE AS bar_time FROM events)
      WHERE hour(bar_time) * 60 + minute(bar_time) BETWEEN 571 AND 690
         OR hour(bar_time) * 60 + minute(bar_time) BETWEEN 780 AND 900
      GROUP BY symbol, bar_time""",
    "nav": """
      SELECT o_orderpriority AS portfolio_id, CAST(o_orderdate AS DATE) AS trade_date,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS equity
      FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "holdings": """
      SELECT substr(symbol, 1, 6) AS symbol, CAST(count(*) AS DOUBLE) AS weight
      FROM bars WHERE symbol LIKE '000%' GROUP BY substr(symbol, 1, 6)""",
    "master": """
      SELECT symbol, min(trade_date) AS list_date,
             CASE WHEN symbol LIKE '430%' THEN max(trade_date) END AS delist_date
      FROM bars GROUP BY symbol""",
    "adj_factor": """
      SELECT symbol, trade_date,
             1.0E0 + CAST(year(trade_date) - 1995 AS DOUBLE) / 8 AS adj_factor
      FROM bars WHERE asset_type = 'etf'""",
    "axis": """
      SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INT) AS date_idx
      FROM (SELECT DISTINCT trade_date FROM bars)""",
    "panel": "SELECT b.*, a.date_idx FROM bars b JOIN axis a USING (trade_date)",
    "etf_bars": "SELECT * FROM bars WHERE asset_type = 'etf'",
    "etf_axis": """
      SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INT) AS date_idx
      FROM (SELECT DISTINCT trade_date FROM etf_bars)""",
    "etf_panel": "SELECT b.*, a.date_idx FROM etf_bars b JOIN etf_axis a USING (trade_date)",
    "stock_bars": "SELECT * FROM bars WHERE asset_type = 'stock'",
    # close of the last date before: the review day / its week / month / year
    "anchor_dates": """
      SELECT max(trade_date) AS latest,
        max(trade_date) FILTER (trade_date < latest_day) AS "当天",
        max(trade_date) FILTER (trade_date < date_trunc('week', latest_day)) AS "本周",
        max(trade_date) FILTER (trade_date < date_trunc('month', latest_day)) AS "本月",
        max(trade_date) FILTER (trade_date < date_trunc('year', latest_day)) AS "今年"
      FROM (SELECT DISTINCT trade_date FROM bars),
           (SELECT max(trade_date) AS latest_day FROM bars)""",
    "rets": """
      SELECT symbol, p0 / py - 1 AS "今年", p0 / pm - 1 AS "本月", p0 / pw - 1 AS "本周",
             p0 / pd - 1 AS "当天"
      FROM (SELECT b.symbol, max(close) FILTER (trade_date = latest) AS p0,
              max(close) FILTER (trade_date = "今年") AS py,
              max(close) FILTER (trade_date = "本月") AS pm,
              max(close) FILTER (trade_date = "本周") AS pw,
              max(close) FILTER (trade_date = "当天") AS pd
            FROM bars b, anchor_dates
            WHERE trade_date IN (latest, "今年", "本月", "本周", "当天") GROUP BY b.symbol)""",
    "rets_long": """
      SELECT * FROM (SELECT symbol, '今年' AS period, "今年" AS ret FROM rets
        UNION ALL SELECT symbol, '本月', "本月" FROM rets
        UNION ALL SELECT symbol, '本周', "本周" FROM rets
        UNION ALL SELECT symbol, '当天', "当天" FROM rets)""",
}


def _uses(text: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", text)]


def statement(body: str, **extra: str) -> str:
    """``body`` preceded by the CTEs it needs; ``extra`` adds statement-local CTEs in order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _uses(text):
            if name not in ordered and VIEWS[name] != text:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    for text in extra.values():
        need(text)
    need(body)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def r(expression: str, digits: int = 8) -> str:
    value = f"round({expression}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END"
