"""Parquet layouts of daily bars, market caps and minute bars: readers and keyed writers.

Bars are laid out by period and by a fixed hash bucket of the symbol, so that one symbol's history is one bucket of every
period and one new day is one slice of its period. Writers find the folders that the incoming rows touch, read those with
partition filters, compute the merged slice once into the shared folder and overwrite from that copy: a job that dies
half-way leaves a whole copy of the slice behind, and the rest of a store is never rewritten.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.constants import BAR_VALUES
from barloom.functions.normalize import with_daily_metadata
from barloom.operators.panel import keep_newest
from barloom.operators.quality import DataQualityError, conflicting_keys
from barloom.schema import DAILY_BAR, MINUTE_BAR
from barloom.session import cut, discard

BUCKETS = 16  # hash buckets of the symbol; fixed for the life of a store
DAILY_PARTITION = ["asset_type", "adjustment", "year", "bucket"]
MINUTE_PARTITION = ["frequency", "year", "month", "bucket"]
_DAILY_KEY = ["symbol", "trade_date", "asset_type", "adjustment"]
_MINUTE_KEY = ["symbol", "bar_time"]


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


# ---- layout ----------------------------------------------------------------------------------
def bucket_of(symbol: Column) -> Column:
    return (F.crc32(symbol.cast("binary")) % BUCKETS).cast("int")


def _buckets(symbols) -> list[int]:
    return sorted({zlib.crc32(symbol.encode("utf-8")) % BUCKETS for symbol in symbols})


def _write(frame: DataFrame, root: str, partition: list[str], order: list[str]) -> None:
    """Range-spread rows so that a large partition is written by many tasks, sorted inside."""
    (
        frame.repartitionByRange(*partition, *order)
        .sortWithinPartitions(*partition, *order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy(*partition).parquet(root)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _folders(frame: DataFrame, columns: list[str]) -> list:
    """Distinct partition values: folder names, so few that they are fetched."""
    return frame.select(*columns).distinct().collect()


def _inside(folders: list, columns: list[str]) -> Column:
    """Partition filter that covers the folders: the values that occur, column by column."""
    if not folders:
        return F.lit(False)
    test = F.lit(True)
    for name in columns:
        test = test & F.col(name).isin(sorted({row[name] for row in folders}))
    return test


def _publish(spark: SparkSession, root: str, merged: DataFrame, partition: list[str], order: list[str],
             before: list = ()) -> None:
    """Overwrite the folders of ``merged`` from a finished copy; then remove those ``before`` that got no row."""
    copy = cut(merged)
    _write(copy, root, partition, order)
    if before:
        conf = spark._jsc.hadoopConfiguration()
        after = {tuple(row) for row in _folders(copy, partition)}
        for row in before:
            if tuple(row[name] for name in partition) not in after:
                tail = "/".join(f"{name}={row[name]}" for name in partition)
                target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{tail}")
                system = target.getFileSystem(conf)
                system.delete(target, True)
                for _ in partition[:-1]:  # folders above that are empty now
                    target = target.getParent()
                    if len(system.listStatus(target)):
                        break
                    system.delete(target, False)
    discard(copy)


def _rank(order: list[str] | None, columns: list[str]) -> Column:
    """What decides between rows of one key: the given order, else the greatest row, whatever the task layout."""
    return F.struct(*(order or columns))


# ---- daily bars ------------------------------------------------------------------------------
def _daily_schema() -> T.StructType:
    extra = [T.StructField("asset_type", T.StringType()), T.StructField("year", T.IntegerType()),
             T.StructField("bucket", T.IntegerType())]
    return T.StructType([*DAILY_BAR.fields, *extra])


def daily_store(spark: SparkSession, root: str, merge_schema: bool = False) -> DataFrame:
    """The stored daily bars. The fixed schema reads older files with nulls for new columns."""
    reader = spark.read
    if merge_schema:
        return reader.option("mergeSchema", "true").parquet(root)
    return reader.schema(_daily_schema()).parquet(root)


def read_daily(spark: SparkSession, root: str, symbols=(), start=None, end=None,
               asset_type: str = "stock", adjustment: str = "none") -> DataFrame:
    """Inclusive date range of one asset type and adjustment; no symbols means all of them."""
    out = daily_store(spark, root).where(
        (F.col("asset_type") == asset_type)
        & (F.coalesce("adjustment", F.lit("none")) == adjustment))
    if start is not None:
        out = out.where((F.col("year") >= F.year(_day(start)))
                        & (F.col("trade_date") >= _day(start)))
    if end is not None:
        out = out.where((F.col("year") <= F.year(_day(end))) & (F.col("trade_date") <= _day(end)))
    if symbols:
        out = out.where(F.col("bucket").isin(_buckets(symbols)) & F.col("symbol").isin(list(symbols)))
    return out.drop("year", "bucket")


def read_daily_dates(spark: SparkSession, root: str, dates: DataFrame, symbols=(),
                     asset_type: str = "stock", adjustment: str = "none") -> DataFrame:
    """Bars of a set of dates; the date frame prunes the year folders at run time."""
    bars = daily_store(spark, root).where(
        (F.col("asset_type") == asset_type) & (F.col("adjustment") == adjustment))
    if symbols:
        bars = bars.where(F.col("bucket").isin(_buckets(symbols)) & F.col("symbol").isin(list(symbols)))
    wanted = dates.select("trade_date").distinct().withColumn("year", F.year("trade_date"))
    return bars.join(F.broadcast(wanted), ["year", "trade_date"], "left_semi").drop(
        "year", "bucket")


def _daily_rows(frame: DataFrame, asset_type: str | None, order: list[str] | None) -> DataFrame:
    rows = with_daily_metadata(frame, asset_type).withColumns(
        {"year": F.year("trade_date"), "bucket": bucket_of(F.col("symbol"))})
    names = [f.name for f in _daily_schema().fields if f.name in rows.columns]
    return rows.select(*names, *[c for c in order or [] if c not in names])


def merge_daily(stored: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Old rows united with new ones by column name. New beats old; of new rows for one key the last by ``order``
    wins, or without an order the greatest row."""
    values = [c for c in incoming.columns if c not in _DAILY_KEY]
    new = incoming.withColumns({"turn": F.lit(1), "rank": _rank(order, values)})
    old = stored.withColumns({"turn": F.lit(0), "rank": F.lit(None)})
    both = old.unionByName(new, allowMissingColumns=True)
    return keep_newest(both, _DAILY_KEY, ["turn", "rank"]).drop("turn", "rank")


def touched_daily(spark: SparkSession, root: str, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Stored rows of the folders whose ``columns`` agree with incoming rows; only those folders are listed."""
    if not _exists(spark, root):
        return spark.createDataFrame([], _daily_schema())
    return daily_store(spark, root).where(_inside(_folders(incoming, columns), columns))


def write_daily(frame: DataFrame, root: str, asset_type: str | None = None,
                order: list[str] | None = None) -> None:
    """Upsert daily bars by (symbol, trade_date, asset_type, adjustment)."""
    spark = frame.sparkSession
    names = [f.name for f in _daily_schema().fields]
    incoming = _daily_rows(frame, asset_type, order)
    stored = touched_daily(spark, root, incoming, DAILY_PARTITION)
    merged = merge_daily(stored, incoming, order).select(*names)
    _publish(spark, root, merged, DAILY_PARTITION, ["symbol", "trade_date"])


def replace_daily(frame: DataFrame, root: str, asset_type: str | None = None,
                  order: list[str] | None = None) -> None:
    """The incoming rows become the whole history of their (symbol, asset_type, adjustment)."""
    spark = frame.sparkSession
    names = [f.name for f in _daily_schema().fields]
    empty = spark.createDataFrame([], _daily_schema())
    incoming = merge_daily(empty, _daily_rows(frame, asset_type, order), order).select(*names)
    _replace(spark, root, incoming, daily_store, DAILY_PARTITION,
             ["asset_type", "adjustment", "bucket"], ["asset_type", "adjustment", "symbol"],
             ["symbol", "trade_date"])


def _replace(spark: SparkSession, root: str, incoming: DataFrame, store, partition: list[str],
             place: list[str], owner: list[str], order: list[str]) -> None:
    """Drop the owners' old rows, add the incoming ones, clear emptied folders.

    Owners can only have rows in folders that share their ``place``; no other folder is read. An empty delivery names
    no owner and therefore deletes nothing.
    """
    if not _exists(spark, root):
        _publish(spark, root, incoming, partition, order)
        return
    owners = incoming.select(*owner).distinct()
    stored = store(spark, root).where(_inside(_folders(incoming, place), place))
    affected = stored.join(owners, owner, "left_semi")
    before = _folders(affected, partition)
    touched = [*before, *_folders(incoming, partition)]
    kept = stored.where(_inside(touched, partition)).join(owners, owner, "left_anti")
    _publish(spark, root, kept.unionByName(incoming).select(*incoming.columns), partition, order, before)


# ---- market caps -----------------------------------------------------------------------------
def basic_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("symbol string, trade_date date, total_mv double, year int").parquet(
        root)


def read_daily_basic(spark: SparkSession, root: str, start=None, end=None) -> DataFrame:
    """Market caps of a date range: year folders are pruned, then row groups by date.

    A full market day is a few thousand rows, so days share a year's files instead of filling
    one small file each.
    """
    out = basic_store(spark, root)
    if start is not None:
        out = out.where((F.col("year") >= F.year(_day(start)))
                        & (F.col("trade_date") >= _day(start)))
    if end is not None:
        out = out.where((F.col("year") <= F.year(_day(end))) & (F.col("trade_date") <= _day(end)))
    return out.drop("year")


def write_daily_basic(frame: DataFrame, root: str, replace_dates: bool = False,
                      order: list[str] | None = None) -> None:
    """Merge (or replace) whole dates; the last row of a (symbol, date) wins."""
    if "total_mv" not in frame.columns:
        raise DataQualityError("market-cap rows need total_mv")
    spark = frame.sparkSession
    columns = ["symbol", "trade_date", "total_mv", "year"]
    rows = frame.withColumns({"year": F.year("trade_date"), "turn": F.lit(1),
                              "rank": _rank(order, ["total_mv"])}).select(*columns, "turn", "rank")
    if _exists(spark, root):
        stored = basic_store(spark, root).where(_inside(_folders(rows, ["year"]), ["year"]))
        if replace_dates:
            delivered = F.broadcast(rows.select("trade_date").distinct())
            stored = stored.join(delivered, "trade_date", "left_anti")
        old = stored.withColumns({"turn": F.lit(0), "rank": F.lit(None)}).select(
            *columns, "turn", "rank")
        rows = rows.union(old)
    merged = keep_newest(rows, ["symbol", "trade_date"], ["turn", "rank"]).select(*columns)
    _publish(spark, root, merged, ["year"], ["trade_date", "symbol"])


# ---- minute bars -----------------------------------------------------------------------------
def _minute_schema() -> T.StructType:
    return T.StructType([*MINUTE_BAR.fields, *[T.StructField(name, T.IntegerType())
                                               for name in ("year", "month", "bucket")]])


def minute_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_minute_schema()).parquet(root)


def read_minute(spark: SparkSession, root: str, symbols, start, end, frequency: str = "5min",
                asset_types=()) -> DataFrame:
    """Bars of named symbols in a closed time range; year folders follow from the range."""
    if not symbols:
        raise ValueError("name at least one symbol")
    first, last = (F.lit(str(v)).cast("timestamp_ntz") for v in (start, end))
    out = minute_store(spark, root).where(
        (F.col("frequency") == frequency) & F.col("bucket").isin(_buckets(symbols))
        & F.col("symbol").isin(list(symbols))
        & F.col("year").between(F.year(first), F.year(last))
        & F.col("bar_time").between(first, last))
    if asset_types:
        out = out.where(F.col("asset_type").isin(list(asset_types)))
    return out.drop("year", "month", "bucket")


def _minute_rows(frame: DataFrame) -> DataFrame:
    rows = frame.withColumns({"year": F.year("bar_time"), "month": F.month("bar_time"),
                              "bucket": bucket_of(F.col("symbol"))})
    return rows.select(*[f.name for f in _minute_schema().fields])


def touched_minutes(spark: SparkSession, root: str, incoming: DataFrame, columns: list[str]) -> DataFrame:
    if not _exists(spark, root):
        return spark.createDataFrame([], _minute_schema())
    return minute_store(spark, root).where(_inside(_folders(incoming, columns), columns))


def write_minute(frame: DataFrame, root: str) -> None:
    """Write minute bars: the rows become their symbols' whole years; other symbols and years stay."""
    _replace(frame.sparkSession, root, _minute_rows(frame), minute_store, MINUTE_PARTITION,
             ["frequency", "year", "bucket"], ["frequency", "symbol", "year"], ["symbol", "bar_time"])


def minute_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(frequency, symbol, bar_time) keys on which old and new rows disagree."""
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return conflicting_keys(both, ["frequency", *_MINUTE_KEY])


def merge_minute_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    both = stored.unionByName(incoming, allowMissingColumns=True)
    return keep_newest(both, ["frequency", *_MINUTE_KEY], ["source"])


def clashing_units(frame: DataFrame, root: str) -> DataFrame:
    """``unit`` of new bars (with that column) that disagree with stored bars, or with bars of a unit before them.

    Of units that only disagree among themselves the first by name stays.
    """
    spark = frame.sparkSession
    rows = _minute_rows(frame)
    stored = touched_minutes(spark, root, rows, MINUTE_PARTITION)
    keys, values = ["frequency", *_MINUTE_KEY], [*BAR_VALUES, "asset_type"]
    tagged = frame.select(*keys, "unit", F.struct(*values).alias("value"))
    known = stored.select(*keys, F.struct(*values).alias("known"))
    against = tagged.join(known, keys).where(~F.col("value").eqNullSafe(F.col("known"))).select("unit").distinct()
    rest = tagged.join(against, "unit", "left_anti")
    first = rest.groupBy(*keys).agg(F.min(F.struct("unit", "value")).alias("first"))
    later = rest.join(first, keys).where(
        (F.col("unit") > F.col("first.unit")) & ~F.col("value").eqNullSafe(F.col("first.value")))
    return against.union(later.select("unit")).distinct()


def merge_minute(frame: DataFrame, root: str) -> None:
    """Incremental merge: equal repeats collapse, a conflicting bar stops the merge."""
    spark = frame.sparkSession
    incoming = _minute_rows(frame)
    stored = touched_minutes(spark, root, incoming, MINUTE_PARTITION)
    clash = minute_conflicts(stored, incoming).take(3)
    if clash:
        keys = ", ".join(f"{row['symbol']} {row['bar_time']}" for row in clash)
        raise DataQualityError(f"minute bars conflict with stored ones: {keys}")
    merged = merge_minute_rows(stored, incoming).select(*incoming.columns)
    _publish(spark, root, merged, MINUTE_PARTITION, ["symbol", "bar_time"])


def mirror_minute(frame: DataFrame, root: str) -> None:
    """Files are the full truth of their symbols: years absent from them disappear."""
    _replace(frame.sparkSession, root, _minute_rows(frame), minute_store, MINUTE_PARTITION,
             ["frequency", "bucket"], ["frequency", "symbol"], ["symbol", "bar_time"])


# ---- result files ----------------------------------------------------------------------------
def json_safe(frame: DataFrame) -> DataFrame:
    """Non-finite numbers become null, so that JSON stays valid."""
    doubles = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return frame.withColumns({
        name: F.when(F.isnan(name) | (F.abs(name) == float("inf")), None).otherwise(F.col(name))
        for name in doubles
    })


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", "true").csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    json_safe(frame).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
