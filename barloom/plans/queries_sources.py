"""Catalogue: readers, ingest, keyed writers and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.constants import BAR_VALUES
from barloom.functions import normalize as N
from barloom.operators import minute as M, quality as Q
from barloom.plans import driver_views as V, staging as G
from barloom.plans.catalogue import query, round_columns
from barloom.plans.oracle_views import r, statement
from barloom.session import cut, scratch_path
from barloom.sources import ingest, lines as L, store, tables
from barloom.streaming import inbox

_CM = G.CODED_MINUTES_SQL
_BAR_LIST = ", ".join(BAR_VALUES)


def staged_daily(spark, root) -> str:
    path = scratch_path(spark, "daily")
    store.write_daily(V.bars(spark, root).withColumn("source", F.lit("view")), path)
    return path


@query("s1_read_daily", statement(
    f"""SELECT symbol, trade_date, {_BAR_LIST}, asset_type, adjustment FROM bars
        WHERE asset_type = 'stock' AND trade_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-15'
          AND symbol IN ('000010.SZ', '000011.SZ', '688000.SH')"""))
def read_daily(spark, root):
    return store.read_daily(spark, staged_daily(spark, root),
                            ["000010.SZ", "000011.SZ", "688000.SH"], "1996-03-01", "1998-02-15",
                            asset_type="stock").drop("source")


@query("s2_read_daily_dates", statement(
    f"""SELECT symbol, trade_date, {_BAR_LIST} FROM bars WHERE asset_type = 'etf' AND trade_date IN
        (SELECT min(trade_date) FROM axis GROUP BY date_trunc('month', trade_date))"""))
def read_daily_dates(spark, root):
    days = V.calendar(spark, root).groupBy(F.trunc("cal_date", "month")).agg(
        F.min("cal_date").alias("trade_date"))
    return store.read_daily_dates(spark, staged_daily(spark, root), days, asset_type="etf").select(
        "symbol", "trade_date", *BAR_VALUES)


def staged_basic(spark, root) -> str:
    path = scratch_path(spark, "basic")
    store.write_daily_basic(V.basic(spark, root), path)
    return path


@query("s3_read_daily_basic", statement(
    """SELECT symbol, trade_date, total_mv FROM basic
       WHERE trade_date BETWEEN DATE '1996-02-10' AND DATE '1996-04-20'"""))
def read_daily_basic(spark, root):
    return store.read_daily_basic(spark, staged_basic(spark, root), "1996-02-10", "1996-04-20")


def tagged_minutes(spark, root, frame=None):
    """Coded minute bars with the stored columns."""
    rows = G.coded_minutes(spark, root) if frame is None else frame
    return rows.select(
        "symbol", F.lit("stock").alias("asset_type"), F.lit("1min").alias("frequency"),
        F.col("bar_time").cast("date").alias("trade_date"), "bar_time", *BAR_VALUES,
        F.lit(False).alias("is_auction"), F.lit("view").alias("source"))


@query("s4_read_minute", statement(
    f"""SELECT symbol, trade_date, bar_time, {_BAR_LIST} FROM cm
        WHERE symbol IN ('000001.SZ', '000004.SZ') AND bar_time BETWEEN
          TIMESTAMP '2024-01-05 10:00:00' AND TIMESTAMP '2024-01-20 14:00:00'""", cm=_CM))
def read_minute(spark, root):
    path = scratch_path(spark, "minute")
    store.write_minute(tagged_minutes(spark, root), path)
    found = store.read_minute(spark, path, ["000001.SZ", "000004.SZ"], "2024-01-05 10:00:00",
                              "2024-01-20 14:00:00", "1min", ["stock"])
    return found.select("symbol", "trade_date", "bar_time", *BAR_VALUES)


@query("s5_directory_csv", statement(
    f"""SELECT symbol, trade_date, bar_time, {_BAR_LIST}, 'stock' AS asset_type,
          '1min' AS frequency, false AS is_auction FROM cm
        WHERE symbol NOT IN ('000005.SZ', '000007.SZ')""", cm=_CM))
def directory_csv(spark, root):
    result = ingest.import_directory(spark, G.minute_directory(spark, root), "1min")
    return result.bars.drop("source")


@query("c20_directory_report", statement(
    """SELECT symbol || '.csv' AS file,
         CASE WHEN symbol IN ('000005.SZ', '000007.SZ') THEN 'failed' ELSE 'success' END AS status,
         CASE symbol WHEN '000005.SZ' THEN 'conflicting rows for one time'
           WHEN '000007.SZ' THEN 'times not ascending' ELSE '' END AS reason,
         count(*) * CASE WHEN symbol IN ('000005.SZ', '000006.SZ') THEN 2 ELSE 1 END AS rows_input,
         CASE WHEN symbol IN ('000005.SZ', '000007.SZ') THEN 0 ELSE count(*) END AS rows_written,
         CASE WHEN symbol = '000006.SZ' THEN count(*) ELSE 0 END AS rows_filtered
       FROM cm GROUP BY symbol""", cm=_CM))
def directory_report(spark, root):
    report = ingest.import_directory(spark, G.minute_directory(spark, root), "1min").report
    return report.select(F.element_at(F.split("unit", "/"), -1).alias("file"), "status", "reason",
                         "rows_input", "rows_written", "rows_filtered")


@query("s6_zip_archives", statement(
    f"""SELECT symbol, trade_date, bar_time, {_BAR_LIST} FROM cm
        WHERE symbol <> '000007.SZ'""", cm=_CM))
def zip_archives(spark, root):
    result = ingest.import_archives(spark, G.minute_archives(spark, root), "1min")
    return result.bars.select("symbol", "trade_date", "bar_time", *BAR_VALUES)


def staged_manifest(spark, root) -> str:
    path = G.minute_directory(spark, root)
    temp = scratch_path(spark, "manifest")
    G.manifest_table(spark, root).coalesce(1).write.option("header", "true").csv(temp)
    G._move(spark, temp, f"{path}/manifest.csv")
    return path


@query("s7_manifest", statement(
    """SELECT CASE WHEN symbol = '000003.SZ' THEN '../' || symbol
           ELSE 'stock/' || symbol || '.csv' END AS relative_file, symbol, 'stock' AS asset_type,
         count(*) * CASE WHEN symbol IN ('000005.SZ', '000006.SZ') THEN 2 ELSE 1 END
           + CASE WHEN symbol = '000004.SZ' THEN 1 ELSE 0 END AS expected_rows,
         CASE WHEN symbol = '000003.SZ' THEN 'path must stay inside the directory' ELSE '' END
           AS problem FROM cm GROUP BY symbol""", cm=_CM))
def manifest(spark, root):
    return ingest.manifest(spark, staged_manifest(spark, root))


@query("v7_manifest_row_counts", statement(
    """SELECT symbol || '.csv' AS file, CASE WHEN symbol IN ('000004.SZ', '000005.SZ', '000007.SZ')
         THEN 'failed' ELSE 'success' END AS status,
         CASE symbol WHEN '000004.SZ' THEN 'row count differs from the manifest'
           WHEN '000005.SZ' THEN 'conflicting rows for one time'
           WHEN '000007.SZ' THEN 'times not ascending' ELSE '' END AS reason
       FROM cm WHERE symbol <> '000003.SZ' GROUP BY symbol""", cm=_CM))
def manifest_row_counts(spark, root):
    path = staged_manifest(spark, root)
    report = ingest.import_directory(spark, path, "1min", use_manifest=True).report
    return report.select(F.element_at(F.split("unit", "/"), -1).alias("file"), "status", "reason")


@query("s8_encodings", statement(
    """SELECT symbol || '.csv' AS file, CASE WHEN CAST(substr(symbol, 6, 1) AS INT) % 2 = 1
         THEN 'GB18030' ELSE 'UTF-8' END AS charset,
         CASE WHEN CAST(substr(symbol, 6, 1) AS INT) % 2 = 1 THEN ';' ELSE ',' END AS sep
       FROM cm GROUP BY symbol""", cm=_CM))
def encodings(spark, root):
    formats = L.file_formats(L.csv_files(spark, G.minute_directory(spark, root)))
    return formats.select(F.element_at(F.split("member", "/"), -1).alias("file"), "charset", "sep")


@query("s9_delimiters_and_headers", statement(
    """SELECT symbol || '.csv' AS file, count(*)
         * CASE WHEN symbol IN ('000005.SZ', '000006.SZ') THEN 2 ELSE 1 END AS rows,
         count(*) * CASE WHEN symbol IN ('000005.SZ', '000006.SZ') THEN 2 ELSE 1 END AS closes
       FROM cm GROUP BY symbol""", cm=_CM))
def delimiters_and_headers(spark, root):
    parsed = L.parse_rows(cut(L.file_formats(L.csv_files(spark, G.minute_directory(spark, root)))))
    return parsed.groupBy(F.element_at(F.split("member", "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(N.to_number(F.col("close"))).alias("closes"))


@query("v9_directory_profile", statement(
    """SELECT 'files' AS finding, 'stock' AS key, count(DISTINCT symbol) - 1 AS count FROM cm""",
    cm=_CM))
def directory_profile(spark, root):
    path = staged_manifest(spark, root)
    formats = L.file_formats(L.csv_files(spark, path).where(
        ~F.col("member").endswith("/manifest.csv")))
    listed = ingest.manifest(spark, path).where(F.col("problem") == "")
    return ingest.directory_profile(
        ingest.directory_sources(formats, path, listed), formats, listed)


@query("s10_vendor_daily", statement(
    """SELECT symbol, trade_date, CAST(NULL AS TIMESTAMP) AS bar_time, open, high, low, close,
         volume, amount, 'vendor' AS source, 'hfq' AS adjustment FROM bars WHERE volume > 3"""))
def vendor_daily(spark, root):
    raw = V.bars(spark, root).select(
        F.col("symbol").alias("ts_code"), N.ymd(F.col("trade_date")).alias("trade_date"),
        F.col("open").cast("string").alias("open"), "high", "low",
        F.when(F.col("volume") > 3, F.col("close").cast("string")).otherwise("n/a").alias("close"),
        F.col("volume").alias("vol"), "amount")
    return tables.canonical_daily(raw, "vendor", rename={"ts_code": "symbol", "vol": "volume"},
                                  adjustment="hfq")


@query("s11_trading_calendar", statement(
    """SELECT DISTINCT cal_date FROM (SELECT trade_date AS cal_date FROM bars
         WHERE year(trade_date) < 1997 UNION ALL
       SELECT trade_date FROM bars WHERE year(trade_date) >= 1999 AND day(trade_date) <> 13)"""))
def trading_calendar(spark, root):
    from barloom.operators.snapshots import trading_days

    days = V.calendar(spark, root)
    first = days.select("cal_date", F.when(F.year("cal_date") < 1997, 1).otherwise(0)
                        .alias("is_open"))
    second = days.where(F.year("cal_date") >= 1999).select(
        F.col("cal_date").alias("calendar_date"),
        F.when(F.dayofmonth("cal_date") != 13, "1").otherwise("0").alias("is_trading_day"))
    return trading_days(first).union(trading_days(second)).distinct()


@query("s12_nav_csv", statement("SELECT portfolio_id, trade_date, equity FROM nav"))
def nav_csv(spark, root):
    base = scratch_path(spark, "nav")
    nav = V.nav(spark, root)
    out = None
    for i, headers in enumerate((("日期", "净值"), ("date", "equity"))):
        part = nav.where(F.col("portfolio_id").startswith("1") == (i == 0)).select(
            "portfolio_id", N.ymd(F.col("trade_date")).alias(headers[0]),
            F.col("equity").cast("decimal(20,2)").alias(headers[1]))
        part.write.option("header", "true").csv(f"{base}-{i}")
        read = tables.read_nav(spark, f"{base}-{i}", "x").drop("portfolio_id")
        keyed = tables.read_text_table(spark, f"{base}-{i}").select(
            "portfolio_id", N.parse_date(F.col(headers[0])).alias("trade_date"),
            N.to_number(F.col(headers[1])).alias("equity"))
        keyed = keyed.join(read.distinct(), ["trade_date", "equity"], "left_semi").select(
            "portfolio_id", "trade_date", "equity")
        out = keyed if out is None else out.union(keyed)
    return out


@query("s13_symbol_list", statement(
    """SELECT DISTINCT CASE WHEN substr(symbol, 1, 3) = '000' THEN '00' || substr(symbol, 3, 4)
         ELSE substr(symbol, 1, 6) END || CASE WHEN symbol LIKE '6%' OR symbol LIKE '5%' THEN '.SH'
         WHEN symbol LIKE '4%' OR symbol LIKE '8%' THEN '.BJ' ELSE '.SZ' END AS symbol FROM bars"""))
def symbol_list(spark, root):
    path = scratch_path(spark, "symbols")
    short = F.regexp_replace(F.substring("symbol", 1, 6), "^0+", "")
    V.bars(spark, root).select(short.alias("正股代码"), "trade_date").write.option(
        "header", "true").csv(path)
    return tables.read_symbol_list(spark, path)


@query("s14_holdings_csv", statement(
    "SELECT symbol || '.SZ' AS symbol, weight FROM holdings"))
def holdings_csv(spark, root):
    path = scratch_path(spark, "holdings")
    V.holdings(spark, root).select(
        F.col("symbol").alias("代码"), F.col("weight").cast("string").alias("权重")
    ).write.option("header", "true").csv(path)
    return tables.read_holdings(spark, path)


@query("s15_schema_evolution", statement(
    """SELECT symbol, trade_date, close, CASE WHEN year(trade_date) < 1998 THEN NULL ELSE amount END
         AS amount, CASE WHEN year(trade_date) < 1998 THEN NULL ELSE 'new' END AS source FROM bars"""))
def schema_evolution(spark, root):
    path = scratch_path(spark, "vintages")
    bars = V.bars(spark, root).withColumns(
        {"year": F.year("trade_date"), "bucket": store.bucket_of(F.col("symbol"))})
    old, new = bars.where("year < 1998"), bars.where("year >= 1998").withColumn(
        "source", F.lit("new"))
    parts = store.DAILY_PARTITION
    old.select("symbol", "trade_date", "close", *parts).write.partitionBy(*parts).parquet(path)
    new.select("symbol", "trade_date", "close", "amount", "source", *parts).write.mode(
        "append").partitionBy(*parts).parquet(path)
    return store.daily_store(spark, path).select(
        "symbol", "trade_date", "close", "amount", "source")


@query("s16_streaming_inbox", statement(
    f"""SELECT symbol, trade_date, bar_time, {_BAR_LIST} FROM cm
        WHERE symbol NOT IN ('000005.SZ', '000006.SZ', '000007.SZ')""", cm=_CM))
def streaming_inbox(spark, root):
    source, target = G.minute_directory(spark, root), scratch_path(spark, "inbox-store")
    inbox.import_new_files(spark, source, target, scratch_path(spark, "inbox-state"), "1min")
    return store.minute_store(spark, target).select(
        "symbol", "trade_date", "bar_time", *BAR_VALUES)


# ---- keyed writers -----------------------------------------------------------------------------
_UPSERT = """SELECT symbol, trade_date, CASE WHEN month(trade_date) = 6 THEN close + 2
      WHEN month(trade_date) = 5 THEN close + 1 ELSE close END AS close FROM bars"""


@query("w1_daily_upsert", statement(_UPSERT))
def daily_upsert(spark, root):
    path = staged_daily(spark, root)
    bars = V.bars(spark, root)
    first = bars.where(F.month("trade_date").isin(5, 6)).withColumns(
        {"close": F.col("close") + 1, "seq": F.lit(1)})
    later = bars.where(F.month("trade_date") == 6).withColumns(
        {"close": F.col("close") + 2, "seq": F.lit(2)})
    store.write_daily(first.unionByName(later), path, order=["seq"])
    return store.daily_store(spark, path).select("symbol", "trade_date", "close")


@query("u1_union_by_name", statement(
    """SELECT symbol, trade_date, close, amount FROM bars UNION ALL
       SELECT symbol, trade_date, open, NULL FROM bars WHERE asset_type = 'etf'"""))
def union_by_name(spark, root):
    bars = V.bars(spark, root)
    other = bars.where(F.col("asset_type") == "etf").select(
        F.col("open").alias("close"), "symbol", "trade_date")
    return bars.select("symbol", "trade_date", "close", "amount").unionByName(
        other, allowMissingColumns=True)


@query("w2_daily_replace", statement(
    """SELECT symbol, trade_date, close FROM bars WHERE asset_type = 'stock'
       UNION ALL SELECT symbol, trade_date, close * 2 FROM bars
       WHERE asset_type = 'etf' AND year(trade_date) >= 1998"""))
def daily_replace(spark, root):
    path = staged_daily(spark, root)
    etf = V.bars(spark, root).where((F.col("asset_type") == "etf") & (F.year("trade_date") >= 1998))
    store.replace_daily(etf.withColumn("close", F.col("close") * 2), path)
    return store.daily_store(spark, path).select("symbol", "trade_date", "close")


@query("w3_daily_basic_replace_dates", statement(
    """SELECT symbol, trade_date, CASE WHEN day(trade_date) = 10 THEN total_mv + 1 ELSE total_mv END
         AS total_mv FROM basic b
       WHERE day(trade_date) <> 9 OR symbol >= '000015' OR NOT EXISTS (SELECT 1 FROM basic k
         WHERE k.trade_date = b.trade_date AND k.symbol >= '000015')"""))
def daily_basic_replace(spark, root):
    path = staged_basic(spark, root)
    basic = V.basic(spark, root)
    changed = basic.where(F.dayofmonth("trade_date") == 10)
    store.write_daily_basic(changed.withColumn("total_mv", F.col("total_mv") + 1), path)
    kept = basic.where((F.dayofmonth("trade_date") == 9) & (F.col("symbol") >= "000015"))
    store.write_daily_basic(kept, path, replace_dates=True)
    return store.read_daily_basic(spark, path)


@query("w4_minute_write", statement(
    f"SELECT symbol, trade_date, bar_time, {_BAR_LIST}, 2024 AS year FROM cm", cm=_CM))
def minute_write(spark, root):
    path = scratch_path(spark, "minute")
    store.write_minute(tagged_minutes(spark, root), path)
    return store.minute_store(spark, path).select(
        "symbol", "trade_date", "bar_time", *BAR_VALUES, "year")


@query("w5_minute_merge", statement(
    f"SELECT symbol, trade_date, bar_time, {_BAR_LIST} FROM cm", cm=_CM))
def minute_merge(spark, root):
    path = scratch_path(spark, "minute")
    rows = tagged_minutes(spark, root)
    store.merge_minute(rows.where(F.dayofmonth("bar_time") <= 20), path)
    store.merge_minute(rows.where(F.dayofmonth("bar_time") >= 10), path)
    return store.minute_store(spark, path).select("symbol", "trade_date", "bar_time", *BAR_VALUES)


@query("w5_minute_conflicts", statement(
    """SELECT '1min' AS frequency, symbol, bar_time, 2 AS n FROM cm
       WHERE day(bar_time) BETWEEN 10 AND 12 AND open <> close""", cm=_CM))
def minute_conflicts(spark, root):
    rows = tagged_minutes(spark, root)
    late = rows.where(F.dayofmonth("bar_time").between(10, 12)).withColumn("close", F.col("open"))
    return store.minute_conflicts(rows, late)


@query("w6_minute_mirror", statement(
    """SELECT symbol, bar_time, close FROM cm WHERE symbol <> '000002.SZ' OR day(bar_time) > 15""",
    cm=_CM))
def minute_mirror(spark, root):
    path = scratch_path(spark, "minute")
    rows = tagged_minutes(spark, root)
    older = rows.where(F.col("symbol") == "000002.SZ").withColumns({
        "bar_time": F.col("bar_time") - F.expr("INTERVAL 366 DAY"),
        "trade_date": F.date_sub("trade_date", 366)})
    store.write_minute(rows.unionByName(older), path)
    store.mirror_minute(rows.where((F.col("symbol") == "000002.SZ")
                                   & (F.dayofmonth("bar_time") > 15)), path)
    return store.minute_store(spark, path).select("symbol", "bar_time", "close")


@query("w9_empty_source_keeps_data", statement(
    "SELECT symbol, count(*) AS rows FROM cm GROUP BY symbol", cm=_CM))
def empty_source_keeps_data(spark, root):
    path = scratch_path(spark, "minute")
    rows = tagged_minutes(spark, root)
    store.write_minute(rows, path)
    store.mirror_minute(rows.where(F.col("symbol") == "no such symbol"), path)
    return store.minute_store(spark, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("w7_calendar_overwrite", statement(
    """SELECT cal_date FROM calendar WHERE cal_date NOT BETWEEN DATE '1996-01-01' AND
         DATE '1996-12-31' OR (day(cal_date) > 5)"""))
def calendar_overwrite(spark, root):
    from barloom.operators.snapshots import calendar_days, replace_calendar_range

    stored = V.calendar(spark, root)
    days = calendar_days(spark, F.lit("1996-01-01").cast("date"),
                         F.lit("1996-12-31").cast("date"))
    known = stored.select("cal_date").withColumn("known", F.lit(1))
    delivered = days.join(known, "cal_date", "left").select(
        "cal_date", F.when(F.col("known").isNotNull() & (F.dayofmonth("cal_date") > 5), 1)
        .otherwise(0).alias("is_open"))
    return replace_calendar_range(stored, delivered)


@query("w8_result_files", statement(
    f"""SELECT portfolio_id, trade_date, equity,
          CASE WHEN day(trade_date) = 1 THEN NULL ELSE equity / 2 END AS half FROM nav"""))
def result_files(spark, root):
    base = scratch_path(spark, "results")
    nav = V.nav(spark, root).withColumn("half", F.when(
        F.dayofmonth("trade_date") == 1, F.lit(float("nan"))).otherwise(F.col("equity") / 2))
    store.write_csv(nav.drop("half"), f"{base}/csv")
    store.write_json(nav, f"{base}/json")
    text = spark.read.schema("portfolio_id string, trade_date date, equity double").option(
        "header", "true").csv(f"{base}/csv")
    halves = spark.read.schema(
        "portfolio_id string, trade_date date, equity double, half double").json(f"{base}/json")
    return text.join(halves.drop("equity"), ["portfolio_id", "trade_date"])


# ---- minute operators --------------------------------------------------------------------------
def _resample_sql(step: int) -> str:
    return f"""SELECT symbol, trade_date, CAST(trade_date AS TIMESTAMP)
          + to_minutes(CAST(base + bucket AS BIGINT)) AS bar_time,
        first(open ORDER BY bar_time) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY bar_time) AS close, sum(volume) AS volume,
        {r('sum(amount)', 4)} AS amount, '{step}min' AS frequency, false AS is_auction
      FROM (SELECT *, ceil(greatest(clock - base, 1) / {step}.0) * {step} AS bucket FROM
        (SELECT *, hour(bar_time) * 60 + minute(bar_time) AS clock,
           CASE WHEN hour(bar_time) < 12 THEN 570 ELSE 780 END AS base FROM minute_bars))
      GROUP BY symbol, trade_date, base, bucket"""


@query("a9_resample_5min", statement(_resample_sql(5)))
def resample_5(spark, root):
    return round_columns(M.resample(V.minute_bars(spark, root), "5min"), "amount", digits=4)


@query("a9_resample_60min", statement(_resample_sql(60)))
def resample_60(spark, root):
    return round_columns(M.resample(V.minute_bars(spark, root), "60min"), "amount", digits=4)


@query("a10_minute_coverage", statement(
    """SELECT 'stock' AS asset_type, count(DISTINCT symbol) AS symbols,
         count(DISTINCT (symbol, year(bar_time))) AS partitions, count(*) AS rows,
         min(bar_time) AS min_time, max(bar_time) AS max_time FROM minute_bars"""))
def minute_coverage(spark, root):
    return M.coverage(V.minute_bars(spark, root).withColumn("asset_type", F.lit("stock")))


@query("v10_minute_audit", statement(
    """SELECT symbol, CAST(year(min(bar_time)) AS INT) AS year,
         CASE WHEN substr(symbol, 6, 1) IN ('0', '1', '2', '3') THEN 'invalid' ELSE 'valid' END
           AS status,
         CASE substr(symbol, 6, 1) WHEN '0' THEN 'row count' WHEN '1' THEN 'null or illegal values'
           WHEN '2' THEN 'session grid' WHEN '3' THEN 'auction flag' ELSE '' END AS reason
       FROM cm GROUP BY symbol""", cm=_CM))
def minute_audit(spark, root):
    rows = tagged_minutes(spark, root)
    catalog = M.catalog(rows).withColumn(
        "rows", F.col("rows") + (F.substring("symbol", 6, 1) == "0").cast("int"))
    code = F.substring("symbol", 6, 1)
    broken = rows.withColumns({
        "high": F.when(code == "1", F.col("low") - 0.001).otherwise(F.col("high")),
        "is_auction": code == "3",
    })
    # code 2: an interior bar is moved off the whole minute
    order = broken.groupBy("symbol").agg(F.min("bar_time").alias("a"), F.max("bar_time").alias("z"))
    moved = broken.join(order, "symbol").withColumn("bar_time", F.when(
        (code == "2") & (F.col("bar_time") > F.col("a")) & (F.col("bar_time") < F.col("z")),
        F.col("bar_time") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("bar_time")))
    return Q.minute_audit(moved.drop("a", "z"), catalog, "1min")


@query("v2_off_grid_times", statement(
    """SELECT symbol, count(*) AS bad_rows, array_to_string(list(strftime(bar_time, '%Y-%m-%d %H:%M:%S')
         ORDER BY bar_time)[1:3], ', ') AS examples FROM (
         SELECT DISTINCT event_type || '.SZ' AS symbol, date_trunc('minute', ts) AS bar_time
         FROM events)
       WHERE NOT ((hour(bar_time) * 60 + minute(bar_time) BETWEEN 570 AND 690
           AND minute(bar_time) % 5 = 0)
         OR (hour(bar_time) * 60 + minute(bar_time) BETWEEN 780 AND 900 AND minute(bar_time) % 5 = 0))
       GROUP BY symbol"""))
def off_grid_times(spark, root):
    times = V.table(spark, root, "events").select(
        F.concat("event_type", F.lit(".SZ")).alias("symbol"), F.lit("stock").alias("asset_type"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bar_time")).distinct()
    found = Q.examples(times, Q.off_grid("5min"), ["symbol"], "bar_time")
    shown = F.transform("examples", lambda t: t.cast("string"))
    return found.withColumn("examples", F.array_join(shown, ", "))


@query("v3_placeholder_filter", statement(
    """SELECT symbol, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM (
         SELECT symbol, NOT (hour(bar_time) = 9 AND minute(bar_time) = 31 AND
           day(bar_time) % 2 = 0) AS keep FROM minute_bars) GROUP BY symbol"""))
def placeholder_filter(spark, root):
    rows = V.minute_bars(spark, root).withColumn("asset_type", F.lit("etf"))
    fake = (N.clock_minutes(F.col("bar_time")) == 571) & (F.dayofmonth("bar_time") % 2 == 0)
    one = {c: F.when(fake, 1.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    zero = {"volume": F.when(fake, 0.0).otherwise(F.col("volume")),
            "amount": F.when(fake, None).otherwise(F.col("amount"))}
    marked = rows.withColumns({**one, **zero})
    return marked.groupBy("symbol").agg(
        F.count_if(~Q.opening_placeholder()).alias("kept"),
        F.count_if(Q.opening_placeholder()).alias("dropped"))
