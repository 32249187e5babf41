"""Vendor-shaped files derived from the input tables, written below the shared scratch folder."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.constants import BAR_VALUES
from barloom.plans import driver_views as V
from barloom.session import scratch_path


def coded_minutes(spark: SparkSession, root: str) -> DataFrame:
    """One-minute bars of eight six-digit codes, from ``events`` by user (prices above zero)."""
    minute = F.date_trunc("minute", "ts") + F.expr("INTERVAL 1 MINUTE")
    ticks = V.table(spark, root, "events").select(
        F.concat(F.lit("00000"), (F.col("user_id") % 8).cast("string"), F.lit(".SZ"))
        .alias("symbol"), "ts", (F.col("value") + 1).alias("value"), minute.cast("timestamp_ntz").alias("bar_time"))
    clock = F.hour("bar_time") * 60 + F.minute("bar_time")
    return ticks.where(clock.between(571, 690) | clock.between(780, 900)).groupBy(
        "symbol", "bar_time"
    ).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        V.money("value").alias("amount"),
    )


CODED_MINUTES_SQL = """
  SELECT symbol, CAST(bar_time AS DATE) AS trade_date, CAST(bar_time AS TIMESTAMP) AS bar_time,
         first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts) AS close, CAST(count(*) AS DOUBLE) AS volume,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM (SELECT '00000' || CAST(user_id % 8 AS VARCHAR) || '.SZ' AS symbol, ts,
               value + 1 AS value, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS bar_time FROM events)
  WHERE hour(bar_time) * 60 + minute(bar_time) BETWEEN 571 AND 690
     OR hour(bar_time) * 60 + minute(bar_time) BETWEEN 780 AND 900
  GROUP BY symbol, bar_time"""

_CHINESE = {
    "symbol": "代码", "trade_time": "时间", "open": "开盘价", "high": "最高价", "low": "最低价",
    "close": "收盘价", "volume": "成交量", "amount": "成交额",
}


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename the one data file Spark wrote below ``source``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(source)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(target).getParent())
    for status in system.listStatus(folder):
        if status.getPath().getName().endswith(".csv"):
            system.rename(status.getPath(), hadoop.Path(target))


def minute_directory(spark: SparkSession, root: str) -> str:
    """stock/<code>.csv per symbol; odd codes use Chinese headers, ``;`` and GB18030.

    Code 5 repeats every time with another volume, code 6 repeats rows identically, code 7 is turned
    upside down.
    """
    base = scratch_path(spark, "minute-dir")
    bars = coded_minutes(spark, root).withColumn(
        "trade_time", F.date_format("bar_time", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "nth", F.unix_date(F.col("bar_time").cast("date")).cast("bigint") * 1440
        + F.hour("bar_time") * 60 + F.minute("bar_time"))
    code = F.substring("symbol", 6, 1).cast("int")
    copies = F.when(code.isin(5, 6), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    bars = bars.select("*", F.explode(copies).alias("copy")).withColumns({
        "volume": F.when((code == 5) & (F.col("copy") == 1), F.col("volume") + 1).otherwise(
            F.col("volume")),
        "nth": F.when(code == 7, -F.col("nth")).otherwise(F.col("nth")),
    })
    columns = ["symbol", "trade_time", *BAR_VALUES]
    for odd, options in ((0, {}), (1, {"sep": ";", "encoding": "GB18030"})):
        part = bars.where(code % 2 == odd).withColumn("file", F.col("symbol"))
        ordered = part.repartition("file").sortWithinPartitions("file", "nth", "copy")
        named = ordered.select("file", *[
            F.col(c).alias(_CHINESE[c] if odd else c) for c in columns])
        named.write.options(header="true", **options).partitionBy("file").csv(f"{base}-{odd}")
        for digit in range(odd, 8, 2):
            _move(spark, f"{base}-{odd}/file=00000{digit}.SZ", f"{base}/stock/00000{digit}.SZ.csv")
    return base


def manifest_table(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows for the staged directory; code 4 claims one row too many."""
    counts = coded_minutes(spark, root).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    code = F.substring("symbol", 6, 1).cast("int")
    rows = F.col("n") * F.when(code.isin(5, 6), 2).otherwise(1) + (code == 4).cast("int")
    path = F.when(code == 3, F.concat(F.lit("../"), "symbol")).otherwise(
        F.concat(F.lit("stock/"), "symbol", F.lit(".csv")))
    return counts.select(F.lit("stock").alias("category"), F.col("symbol").alias("ts_code"),
                         path.alias("relative_file"), rows.cast("string").alias("rows"))


def minute_archives(spark: SparkSession, root: str) -> str:
    """One ZIP per symbol with a member per month-half; code 7's second member overlaps the first."""
    base = scratch_path(spark, "minute-zip")
    spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(
        spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(base))
    rows = coded_minutes(spark, root).select(
        "symbol", F.date_format("bar_time", "yyyy-MM-dd").alias("date"),
        F.date_format("bar_time", "HH:mm:ss").alias("time"), *BAR_VALUES)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        symbol = part["symbol"].iat[0]
        part = part.sort_values(["date", "time"]).rename(columns={"symbol": "code"})
        middle = part["date"].min()[:8] + "16"
        first, second = part[part["date"] < middle], part[part["date"] >= middle]
        if symbol.startswith("000007"):
            second = pd.concat([first.tail(1), second])
        system, inner = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
        with system.open_output_stream(f"{inner}/{symbol}.zip") as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
                target.writestr("stock/a.csv", first.to_csv(index=False))
                target.writestr("stock/b.csv", second.to_csv(index=False))
        return pd.DataFrame({"symbol": [symbol], "rows": [len(part)]})

    rows.groupBy("symbol").applyInPandas(pack, "symbol string, rows bigint").collect()
    return base
