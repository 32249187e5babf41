"""Catalogue: normalisation, data-quality rules and dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import normalize as N
from barloom.operators import quality as Q, review as R, snapshots as Snap
from barloom.plans import driver_views as V
from barloom.plans.catalogue import query, round_columns, rounded
from barloom.plans.oracle_views import r, statement
from barloom.sources import ingest, tables


# ---- scalar functions over whole tables ---------------------------------------------------------
@query("n1_minute_symbols", """
  WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 4 AS INT) AS k,
      lpad(CAST(l_partkey * 613 % 1000000 AS VARCHAR), 6, '0') AS code FROM lineitem)
  SELECT code AS raw, k, CASE k WHEN 0 THEN code || '.SZ' WHEN 1 THEN code || '.BJ'
      WHEN 2 THEN code || '.SH' ELSE code || CASE WHEN left(code, 1) IN ('5', '6', '9') THEN '.SH'
      ELSE '.SZ' END END AS symbol, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def minute_symbols(spark, root):
    k = (F.col("l_partkey") % 4).cast("int")
    code = F.lpad((F.col("l_partkey") * 613 % 1000000).cast("string"), 6, "0")
    shaped = (
        F.when(k == 0, F.concat(F.lit(" sz."), code)).when(k == 1, F.concat(code, F.lit(".bj ")))
        .when(k == 2, F.concat(code, F.lit(".CSI"))).otherwise(code))
    rows = V.table(spark, root, "lineitem").select(
        code.alias("raw"), k.alias("k"), N.minute_symbol(shaped).alias("symbol"))
    return rows.groupBy("raw", "k", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("n2_stock_symbols", """
  SELECT code, lpad(code, CAST(greatest(6, length(code)) AS INT), '0') || CASE
      WHEN left(lpad(code, CAST(greatest(6, length(code)) AS INT), '0'), 1) IN ('5', '6', '9') THEN '.SH'
      WHEN left(lpad(code, CAST(greatest(6, length(code)) AS INT), '0'), 1) IN ('4', '8') THEN '.BJ'
      ELSE '.SZ' END AS symbol
  FROM (SELECT DISTINCT CAST(o_orderkey * 37 AS VARCHAR) AS code FROM orders)""")
def stock_symbols(spark, root):
    code = (F.col("o_orderkey") * 37).cast("string")
    return V.table(spark, root, "orders").select(code.alias("code")).distinct().select(
        "code", N.stock_symbol(F.concat("code", F.lit(".XX"))).alias("symbol"))


@query("n3_b_shares", """
  SELECT c_custkey, (ex = 'SZ' AND left(code, 1) = '2') OR (ex = 'SH' AND left(code, 1) = '9')
    AS b_share FROM (SELECT c_custkey, CAST(c_custkey * 7919 % 1000000 AS VARCHAR) AS code,
      CASE c_nationkey % 3 WHEN 0 THEN 'SZ' WHEN 1 THEN 'SH' ELSE 'BJ' END AS ex FROM customer)""")
def b_shares(spark, root):
    code = (F.col("c_custkey") * 7919 % 1000000).cast("string")
    k = F.col("c_nationkey") % 3
    exchange = F.when(k == 0, "sz").when(k == 1, "SH").otherwise("BJ")
    return V.table(spark, root, "customer").select(
        "c_custkey", N.is_b_share(F.concat_ws(".", code, exchange)).alias("b_share"))


@query("n4_asset_types", """
  SELECT asset_type, count(*) AS n FROM (SELECT CASE
      WHEN code LIKE '399%' OR code LIKE '93%' OR (ex = 'SH' AND code LIKE '000%') THEN 'index'
      WHEN code LIKE '5%' OR code LIKE '15%' OR code LIKE '16%' THEN 'etf' ELSE 'stock' END
      AS asset_type FROM (SELECT lpad(CAST(l_partkey * 613 % 1000000 AS VARCHAR), 6, '0') AS code,
        CASE WHEN l_suppkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS ex FROM lineitem))
  GROUP BY asset_type""")
def asset_types(spark, root):
    code = F.lpad((F.col("l_partkey") * 613 % 1000000).cast("string"), 6, "0")
    exchange = F.when(F.col("l_suppkey") % 2 == 0, "SH").otherwise("SZ")
    kind = N.minute_asset_type(F.concat_ws(".", code, exchange), F.lit("misc"))
    return V.table(spark, root, "lineitem").groupBy(kind.alias("asset_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("n5_symbols_from_file_names", """
  SELECT s_suppkey, lpad(CAST(s_suppkey * 31 % 1000000 AS VARCHAR), 6, '0') || CASE
      WHEN s_suppkey % 2 = 0 THEN '.BJ' WHEN left(lpad(CAST(s_suppkey * 31 % 1000000 AS VARCHAR),
        6, '0'), 1) IN ('5', '6', '9') THEN '.SH' ELSE '.SZ' END AS symbol FROM supplier""")
def symbols_from_file_names(spark, root):
    code = F.lpad((F.col("s_suppkey") * 31 % 1000000).cast("string"), 6, "0")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(code, F.lit("_bj_1min.csv"))).otherwise(
        F.concat(F.lit("x"), code, F.lit("-2024.csv")))
    path = F.concat(F.lit("file:/data/999999/"), name)
    return V.table(spark, root, "supplier").select(
        "s_suppkey", N.symbol_from_file_name(path).alias("symbol"))


@query("n6_header_mapping", """
  SELECT doc_id, CASE lang WHEN 'en' THEN 'close' WHEN 'zh' THEN 'trade_date' END AS canonical
  FROM documents""")
def header_mapping(spark, root):
    headers = {"en": " Close ", "zh": "交易日期"}
    mapped = N.map_headers(headers.values())
    target = F.create_map(*[F.lit(x) for k, v in headers.items() for x in (k, mapped[v])])
    return V.table(spark, root, "documents").select(
        "doc_id", F.try_element_at(target, F.col("lang")).alias("canonical"))


@query("n7_numeric_coercion", """
  SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_linenumber > 2) AS numbers,
    count(*) FILTER (l_linenumber <= 2) AS nulls FROM lineitem GROUP BY l_returnflag""")
def numeric_coercion(spark, root):
    text = F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "NaN")
    value = N.to_number(text.otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))))
    return V.table(spark, root, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("numbers"),
        F.count_if(value.isNull()).alias("nulls"))


@query("n8_date_parsing", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END
      AS parsed, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders""")
def date_parsing(spark, root):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "yyyy/M/d"))
        .when(k == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("99:99")))
    return V.table(spark, root, "orders").select(
        "o_orderkey", N.parse_date(text).alias("parsed"), N.ymd(day).alias("compact"))


@query("n9_date_and_clock", """
  SELECT event_id, date_trunc('second', ts) AS bar_time FROM events""")
def date_and_clock(spark, root):
    split = F.col("event_id") % 2 == 0
    day = F.date_format("ts", "yyyyMMdd")
    clock = F.when(split, F.date_format("ts", "H:mm:ss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    joined = N.parse_time(N.join_date_and_clock(day, clock))
    return V.table(spark, root, "events").select("event_id", joined.alias("bar_time"))


@query("n10_bar_end", statement(
    """SELECT symbol, bar_time AS source_time, bar_time + INTERVAL 5 MINUTE AS bar_end
       FROM minute_bars"""))
def bar_end(spark, root):
    return V.minute_bars(spark, root).select(
        "symbol", N.to_bar_end(F.col("bar_time"), "5min").alias("source_time"),
        N.to_bar_end(F.col("bar_time"), "5min", "bar_start").alias("bar_end"))


@query("n11_auction_flag", """
  SELECT event_id, event_type = 'click' AND hour(ts) = 9 AND minute(ts) = 30 AND second(ts) = 0
    AS is_auction FROM events""")
def auction_flag(spark, root):
    kind = F.when(F.col("event_type") == "click", "stock").otherwise("etf")
    return V.table(spark, root, "events").select(
        "event_id", N.is_auction(kind, F.col("ts")).alias("is_auction"))


@query("n12_metadata_defaults", statement(
    """SELECT asset_type, CASE WHEN day(trade_date) % 2 = 0 THEN 'hfq' ELSE 'none' END
         AS adjustment, count(*) AS n FROM bars GROUP BY 1, 2"""))
def metadata_defaults(spark, root):
    label = F.when(F.dayofmonth("trade_date") % 2 == 0, F.lit("hfq"))
    rows = N.with_daily_metadata(V.bars(spark, root).withColumn("adjustment", label))
    return rows.groupBy("asset_type", "adjustment").agg(F.count(F.lit(1)).alias("n"))


@query("j2_adjusted_prices", statement(
    f"""SELECT symbol, trade_date, {r('close * adj_factor', 6)} AS close,
          {r('open * adj_factor', 6)} AS open
        FROM bars JOIN adj_factor USING (symbol, trade_date)"""))
def adjusted_prices(spark, root):
    etf = V.bars(spark, root).where(F.col("asset_type") == "etf")
    adjusted = tables.adjust_prices(etf, V.adj_factor(spark, root))
    return adjusted.select("symbol", "trade_date", rounded("close", 6).alias("close"),
                           rounded("open", 6).alias("open"))


@query("j2_uncovered_factors", statement(
    """SELECT symbol, trade_date FROM bars WHERE asset_type = 'etf' AND year(trade_date) = 1995"""))
def uncovered_factors(spark, root):
    etf = V.bars(spark, root).where(F.col("asset_type") == "etf")
    later = V.adj_factor(spark, root).where(F.year("trade_date") != 1995)
    return tables.uncovered_factors(etf, later).select("symbol", "trade_date")


_SUSPENDED = """SELECT symbol, trade_date, CASE WHEN hit THEN close ELSE open END AS open,
      CASE WHEN hit THEN close ELSE high END AS high, close, hit AS suspended FROM (
    SELECT symbol, trade_date, close, volume = 1 AND symbol < '5' AS hit,
      CASE WHEN volume = 1 THEN 0 ELSE open END AS open,
      CASE WHEN volume = 1 THEN 0 ELSE high END AS high FROM bars)"""


@query("n14_suspended_placeholders", statement(_SUSPENDED))
def suspended_placeholders(spark, root):
    bars = V.bars(spark, root)
    idle = F.col("volume") == 1
    blank = {c: F.when(idle, 0.0).otherwise(F.col(c))
             for c in ("open", "high", "low", "amount", "volume")}
    evidence = bars.where(F.col("symbol") < "5").select(
        "symbol", "trade_date", (F.col("close") * (1 + 1e-12)).alias("pre_close"))
    attached = tables.attach_previous_close(bars.withColumns(blank), evidence)
    return tables.fill_suspended(attached).select(
        "symbol", "trade_date", "open", "high", "close", "suspended")


@query("j3_previous_close_evidence", statement(
    """SELECT symbol, trade_date, close, CASE WHEN asset_type = 'etf' THEN open END AS pre_close
       FROM bars"""))
def previous_close_evidence(spark, root):
    bars = V.bars(spark, root)
    evidence = bars.where(F.col("asset_type") == "etf").select(
        "symbol", "trade_date", F.col("open").cast("string").alias("pre_close"))
    return tables.attach_previous_close(bars, evidence).select(
        "symbol", "trade_date", "close", "pre_close")


@query("n15_code_exclusion", statement(
    """SELECT symbol, count(*) AS n FROM bars WHERE NOT regexp_matches(symbol, '^(688|8|4)')
       GROUP BY symbol"""))
def code_exclusion(spark, root):
    kept = V.bars(spark, root).where(~N.code_excluded(F.col("symbol")))
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("n16_display_text", statement(
    """SELECT portfolio_id, trade_date, CASE WHEN day(trade_date) = 3 THEN '' ELSE
         printf('%.2f%%', (equity / 1000000 - 1) * 100) END AS pct,
         CASE WHEN day(trade_date) = 3 THEN '—' ELSE printf('%.2f', equity / 7) END AS num,
         CAST(CAST(floor(equity) AS BIGINT) AS VARCHAR) AS cnt FROM nav"""))
def display_text(spark, root):
    hidden = F.dayofmonth("trade_date") == 3
    shown = F.when(~hidden, F.col("equity"))
    return V.nav(spark, root).select(
        "portfolio_id", "trade_date", N.percent_text(shown / 1000000 - 1).alias("pct"),
        N.number_text(shown / 7).alias("num"), N.count_text(F.floor("equity")).alias("cnt"))


@query("n17_denoised_returns", statement(
    """SELECT count(*) FILTER (round(close / open - 1, 12) = 0) AS flat,
         count(*) FILTER (round(close / open - 1, 12) > 0) AS up, count(*) AS n FROM bars"""))
def denoised_returns(spark, root):
    value = N.denoise(F.col("close") / F.col("open") - 1)
    return V.bars(spark, root).agg(F.count_if(value == 0).alias("flat"),
                                   F.count_if(value > 0).alias("up"),
                                   F.count(F.lit(1)).alias("n"))


@query("n19_session_clock", """
  SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS clock,
    extract('microsecond' FROM ts) = 0 AND second(ts) = 0 AS whole FROM events""")
def session_clock(spark, root):
    return V.table(spark, root, "events").select(
        "event_id", N.clock_minutes(F.col("ts")).alias("clock"),
        N.whole_minute(F.col("ts")).alias("whole"))


@query("n20_log_bias", statement(
    f"SELECT symbol, trade_date, {r('(ln(close) - ln(open)) * 100', 6)} AS bias FROM bars"))
def log_bias(spark, root):
    return V.bars(spark, root).select("symbol", "trade_date", rounded(
        N.log_bias(F.col("close"), F.col("open")), 6).alias("bias"))


# ---- quality rules -------------------------------------------------------------------------------
def dirty_bars(spark, root):
    """Bars with planted faults: blank keys, inverted prices, negative volume, repeats."""
    bars = V.bars(spark, root)
    day = F.dayofmonth("trade_date")
    faulty = bars.withColumns({
        "symbol": F.when((day == 1) & (F.col("symbol") < "00001"), "  ").otherwise(
            F.col("symbol")),
        "high": F.when(day == 2, F.col("low") / 2).otherwise(F.col("high")),
        "volume": F.when(day == 3, -F.col("volume")).otherwise(F.col("volume")),
        "amount": F.when(day % 3 == 1, None).otherwise(F.col("amount")),
    })
    return faulty.unionByName(faulty.where(day == 5))


_DIRTY = """SELECT CASE WHEN day(trade_date) = 1 AND symbol < '00001' THEN '  ' ELSE symbol END
      AS symbol, trade_date, open, CASE WHEN day(trade_date) = 2 THEN low / 2 ELSE high END AS high,
      low, close, CASE WHEN day(trade_date) = 3 THEN -volume ELSE volume END AS volume,
      CASE WHEN day(trade_date) % 3 = 1 THEN NULL ELSE amount END AS amount FROM
    (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE day(trade_date) = 5)"""


@query("v1_validate_bars", statement(
    """SELECT 'empty' AS rule, 'error' AS level, 0 AS bad_rows UNION ALL
       SELECT 'required', 'error', count(*) FILTER (trim(symbol) = '') FROM dirty UNION ALL
       SELECT 'duplicate', 'error', (SELECT count(*) FROM dirty) -
         (SELECT count(*) FROM (SELECT DISTINCT symbol, trade_date FROM dirty)) UNION ALL
       SELECT 'ohlc', 'error', count(*) FILTER (high < greatest(open, close, low) OR
         low > least(open, close, high) OR least(open, high, low, close) <= 0) FROM dirty UNION ALL
       SELECT 'trade', 'error', count(*) FILTER (volume < 0 OR amount < 0) FROM dirty UNION ALL
       SELECT 'amount_mostly_null', 'warning', CASE WHEN count(*) FILTER (amount IS NULL) >
         0.2 * count(*) THEN count(*) FILTER (amount IS NULL) ELSE 0 END FROM dirty""",
    dirty=_DIRTY))
def validate_bars(spark, root):
    return Q.validate_bars(dirty_bars(spark, root))


@query("v5_conflicting_duplicates", """
  SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2
  HAVING count(DISTINCT l_quantity) > 1 OR count(DISTINCT l_extendedprice) > 1
    OR count(DISTINCT l_discount) > 1 OR count(DISTINCT l_tax) > 1""")
def conflicting_duplicates(spark, root):
    rows = V.table(spark, root, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_quantity").alias("open"),
        F.col("l_extendedprice").alias("high"), F.col("l_discount").alias("low"),
        F.col("l_tax").alias("close"), F.lit(1.0).alias("volume"),
        F.lit(None).cast("double").alias("amount"))
    return Q.conflicting_keys(rows, ["l_partkey", "l_suppkey"])


@query("v4_unparsable_rows", """
  SELECT user_id, count(*) FILTER (event_id % 7 = 0) AS bad_rows, count(*) AS rows FROM events
  GROUP BY user_id HAVING count(*) FILTER (event_id % 7 = 0) > 0""")
def unparsable_rows(spark, root):
    price = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    rows = V.table(spark, root, "events").select(
        "user_id", F.lit("000001.SZ").alias("symbol"), F.col("ts").alias("bar_time"),
        *[N.to_number(price).alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"))
    return rows.groupBy("user_id").agg(
        F.count_if(ingest.unparsable(check_symbol=True)).alias("bad_rows"), F.count(F.lit(1)).alias("rows")
    ).where(F.col("bad_rows") > 0)


@query("v6_time_order", """
  SELECT DISTINCT unit FROM (SELECT unit, o_orderdate < lag(o_orderdate) OVER (PARTITION BY unit
      ORDER BY o_orderkey) AS back
    FROM (SELECT *, CAST(o_custkey AS VARCHAR) || o_orderstatus AS unit FROM orders)) WHERE back""")
def time_order(spark, root):
    from barloom.sources.ingest import out_of_order

    unit = F.concat(F.col("o_custkey").cast("string"), "o_orderstatus")
    rows = V.table(spark, root, "orders").select(
        unit.alias("unit"), unit.alias("member"), F.lit("A").alias("symbol"),
        F.floor(F.col("o_orderkey") / 1000).alias("block"), F.col("o_orderkey").alias("pos"),
        F.col("o_orderdate").alias("bar_time"))
    return out_of_order(rows)


@query("v8_symbol_mismatch", """
  SELECT l_suppkey, count(*) FILTER (l_partkey % 50 <> l_suppkey % 50) AS mismatched FROM lineitem
  GROUP BY l_suppkey""")
def symbol_mismatch(spark, root):
    inside = N.minute_symbol((F.col("l_partkey") % 50).cast("string"))
    claimed = N.symbol_from_file_name(F.concat(
        F.lit("/x/"), (F.col("l_suppkey") % 50).cast("string"), F.lit(".csv")))
    rows = V.table(spark, root, "lineitem").select(
        "l_suppkey", inside.alias("symbol"), claimed.alias("file_symbol"))
    return rows.groupBy("l_suppkey").agg(F.count_if(ingest.other_symbol()).alias("mismatched"))


@query("v11_basic_validation", statement(
    """SELECT trade_date, count(*) AS rows, count(*) FILTER (bad) AS bad FROM (
         SELECT trade_date, day(trade_date) IN (4, 5) AS bad FROM basic) GROUP BY trade_date"""))
def basic_validation(spark, root):
    day = F.dayofmonth("trade_date")
    faulty = V.basic(spark, root).withColumns({
        "symbol": F.when(day == 4, " ").otherwise(F.col("symbol")),
        "total_mv": F.when(day == 5, "-1").otherwise(F.col("total_mv").cast("string"))})
    return faulty.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(Snap.bad_market_cap()).alias("bad"))


@query("v15_label_check", statement(
    """SELECT symbol, count(*) AS rows, count(*) FILTER (day(trade_date) = 7) AS mislabelled
       FROM bars GROUP BY symbol"""))
def label_check(spark, root):
    label = F.when(F.dayofmonth("trade_date") == 7, "qfq").otherwise("none")
    return Q.label_check(V.bars(spark, root).withColumn("adjustment", label), ["symbol"], "none")


@query("v17_weight_violations", statement(
    f"""SELECT trade_date, {r('min(w)', 10)} AS smallest, {r('sum(w)', 9)} AS total FROM (
          SELECT trade_date, (close - 20000) / 400000 AS w FROM bars) GROUP BY trade_date
        HAVING min(w) < -1e-12 OR sum(w) > 1.000001"""))
def weight_violations(spark, root):
    weights = V.bars(spark, root).select(
        "trade_date", ((F.col("close") - 20000) / 400000).alias("weight"))
    found = round_columns(Q.weight_violations(weights, ["trade_date"]), "smallest", digits=10)
    return round_columns(found, "total", digits=9)


@query("v20_clean_nav", """
  SELECT o_orderpriority AS portfolio_id, CAST(o_orderdate AS DATE) AS trade_date,
    arg_max(o_totalprice, o_orderkey) AS equity FROM orders GROUP BY 1, 2""")
def clean_nav(spark, root):
    from barloom.operators.review import clean_nav as clean

    rows = V.table(spark, root, "orders").select(
        F.col("o_orderpriority").alias("portfolio_id"),
        F.col("o_orderdate").cast("date").alias("trade_date"),
        F.col("o_totalprice").cast("string").alias("equity"), F.col("o_orderkey").alias("seq"))
    return clean(rows).drop("seq")


# ---- joins ---------------------------------------------------------------------------------------
@query("j1_missing_market_caps", statement(
    """SELECT trade_date, count(*) AS bad_rows, array_to_string(list(symbol ORDER BY symbol)[1:3],
         ',') AS examples FROM stock_bars b ANTI JOIN basic m ON m.symbol = b.symbol AND
         m.trade_date = b.trade_date GROUP BY trade_date"""))
def missing_market_caps(spark, root):
    stocks = V.bars(spark, root).where(F.col("asset_type") == "stock")
    found = Q.missing_market_caps(stocks, V.basic(spark, root))
    return found.withColumn("examples", F.array_join("examples", ","))


@query("j4_active_universe", statement(
    """SELECT c.cal_date, count(DISTINCT m.symbol) AS active FROM calendar c LEFT JOIN (
         SELECT symbol, list_date, delist_date FROM master
         UNION ALL SELECT symbol, list_date + 40, delist_date FROM master WHERE symbol < '000010') m
         ON m.list_date <= c.cal_date AND (m.delist_date IS NULL OR m.delist_date > c.cal_date)
       GROUP BY c.cal_date"""))
def active_universe(spark, root):
    master = V.master(spark, root).select("symbol", "list_date", "delist_date")
    again = master.where(F.col("symbol") < "000010").withColumn("list_date", F.date_add("list_date", 40))
    return Snap.active_counts(master.union(again), V.calendar(spark, root))


@query("j5_active_bars", statement(
    """SELECT b.symbol, b.trade_date FROM bars b JOIN master m USING (symbol)
       WHERE m.list_date <= b.trade_date AND (m.delist_date IS NULL OR
         m.delist_date > b.trade_date)"""))
def active_bars(spark, root):
    return Snap.active_bars(V.bars(spark, root), V.master(spark, root)).select(
        "symbol", "trade_date")


@query("j6_delist_dates", statement(
    """SELECT symbol, list_date, coalesce(delist_date, CASE WHEN symbol LIKE '5%' THEN list_date +
         100 END) AS delist_date FROM master"""))
def delist_dates(spark, root):
    master = V.master(spark, root)
    funds = master.where(F.col("symbol").startswith("5")).select(
        "symbol", F.date_add("list_date", 100).alias("delist_date"))
    return Snap.fill_delist_dates(master, funds)


@query("u2_stacked_masters", statement(
    """SELECT symbol, CASE WHEN symbol < '00001' THEN DATE '2001-01-01' ELSE list_date END
         AS list_date FROM master"""))
def stacked_masters(spark, root):
    master = V.master(spark, root).select("symbol", "list_date")
    later = master.where(F.col("symbol") < "00001").withColumn(
        "list_date", F.lit("2001-01-01").cast("date"))
    return Snap.stack_masters(master, later)


@query("u3_symbol_differences", statement(
    """SELECT symbol, bool_or(side = 'a') AS in_first, bool_or(side = 'b') AS in_second FROM (
         SELECT symbol, 'a' AS side FROM bars WHERE trade_date = (SELECT min(trade_date) FROM bars)
         UNION ALL SELECT symbol, 'b' FROM bars WHERE trade_date = (SELECT max(trade_date)
           FROM bars)) GROUP BY symbol HAVING count(DISTINCT side) = 1"""))
def symbol_differences(spark, root):
    bars = V.bars(spark, root)
    ends = bars.agg(F.struct(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
                    .alias("ends")).scalar()
    return Snap.symbol_differences(bars.where(F.col("trade_date") == ends["a"]),
                                   bars.where(F.col("trade_date") == ends["b"]))


@query("u4_distinct_groups", statement(
    "SELECT DISTINCT symbol, adjustment, asset_type FROM bars"))
def distinct_groups(spark, root):
    return V.bars(spark, root).select("symbol", "adjustment", "asset_type").distinct()


@query("j16_named_dimension", """
  SELECT n_name AS name, CAST(n_nationkey AS INT) AS ordinal, coalesce(n, 0) AS customers
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
    ON c_nationkey = n_nationkey""")
def named_dimension(spark, root):
    counts = V.table(spark, root, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"))
    nations = V.table(spark, root, "nation")
    joined = nations.join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal"),
                         F.coalesce("n", F.lit(0)).alias("customers")).orderBy("ordinal")


@query("j17_underlying_subset", statement(
    """SELECT symbol, count(*) AS n FROM bars WHERE symbol IN
         (SELECT symbol || '.SZ' FROM holdings WHERE weight > 1700) GROUP BY symbol"""))
def underlying_subset(spark, root):
    wanted = V.holdings(spark, root).where(F.col("weight") > 1700).select(
        N.stock_symbol(F.col("symbol")).alias("symbol"))
    kept = V.bars(spark, root).join(wanted, "symbol", "left_semi")
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("j15_rescaled_weights", statement(
    f"""SELECT symbol || '.SZ' AS symbol, {r('weight / (SELECT sum(weight) FROM holdings)')}
          AS weight FROM holdings"""))
def rescaled_weights(spark, root):
    return R.scaled_weights(V.holdings(spark, root)).select("symbol", rounded("weight").alias("weight"))


@query("k9_examples", statement(
    """SELECT symbol, count(*) AS bad_rows, array_to_string(list(strftime(trade_date, '%Y-%m-%d')
         ORDER BY trade_date)[1:3], ',') AS examples FROM bars WHERE volume = 1 GROUP BY symbol"""))
def examples(spark, root):
    found = Q.examples(V.bars(spark, root), F.col("volume") == 1, ["symbol"], "trade_date")
    return found.withColumn("examples", F.array_join(
        F.transform("examples", lambda d: d.cast("string")), ","))
