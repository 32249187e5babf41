"""Minute-file ingest: normalise lines, judge every file or archive, keep the accepted rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.constants import (
    BAR_VALUES,
    MINUTE_ASSET_TYPES,
    MINUTE_COLUMNS,
    MINUTE_FREQUENCIES,
    OHLC,
)
from barloom.functions import normalize as N
from barloom.operators import quality as Q
from barloom.operators.panel import keep_newest
from barloom.session import cut
from barloom.sources import archive, lines as L

REQUIRED = {"symbol", "bar_time", "open", "high", "low", "close", "volume"}


@dataclass(frozen=True)
class Ingest:
    bars: DataFrame
    report: DataFrame


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """manifest.csv: (relative_file, symbol, asset_type, expected_rows, problem)."""
    raw = spark.read.option("header", "true").csv(f"{root}/manifest.csv")
    raw = raw.toDF(*[name.lstrip("﻿") for name in raw.columns])
    absent = {"category", "ts_code", "relative_file"} - set(raw.columns)
    if absent:
        raise Q.DataQualityError(f"manifest.csv lacks {sorted(absent)}")
    path = F.trim(F.coalesce("relative_file", F.lit("")))
    unsafe = (path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    rows = F.trim("rows").try_cast("bigint") if "rows" in raw.columns else F.lit(None)
    return raw.select(
        path.alias("relative_file"), N.minute_symbol(F.col("ts_code")).alias("symbol"),
        F.lower(F.trim("category")).alias("asset_type"), rows.cast("bigint").alias("expected_rows"),
        F.when(unsafe, "path must stay inside the directory").otherwise("").alias("problem"),
    )


def relative_path(member: Column, root: str) -> Column:
    """Path below the import root, which is matched as a path fragment of the file URI."""
    return F.regexp_replace(member, f"^.*?{_quoted(root.rstrip('/'))}/", "")


def _quoted(text: str) -> str:
    return "\\Q" + text.removeprefix("file:") + "\\E"


def discovered(members: DataFrame, root: str) -> DataFrame:
    """Symbol and asset type of files found without a manifest (name and first folder)."""
    relative = relative_path(F.col("member"), root)
    folder = F.when(F.contains(relative, F.lit("/")), F.lower(F.substring_index(relative, "/", 1)))
    symbol = N.symbol_from_file_name(F.col("member"))
    return members.select(
        "member", relative.alias("relative_file"), symbol.alias("file_symbol"),
        N.minute_asset_type(symbol, F.coalesce(folder, F.lit(""))).alias("file_asset_type"),
        F.lit(None).cast("bigint").alias("expected_rows"),
    )


def directory_sources(formats: DataFrame, root: str, listed: DataFrame | None) -> DataFrame:
    """Files to import with the symbol and type they claim; a manifest decides when present."""
    members = formats.select("member")
    if listed is None:
        return discovered(members, root)
    named = members.withColumn("relative_file", relative_path(F.col("member"), root))
    return named.join(listed.where(F.col("problem") == ""), "relative_file").select(
        "member", "relative_file", F.col("symbol").alias("file_symbol"),
        F.col("asset_type").alias("file_asset_type"), "expected_rows",
    )


def directory_profile(sources: DataFrame, formats: DataFrame,
                      listed: DataFrame | None = None) -> DataFrame:
    """Findings of a directory check: (finding, key, count)."""
    headers = L.has_columns(formats, REQUIRED)
    joined = sources.join(headers, "member", "left").join(formats.select("member", "error"), "member", "left")
    findings = [
        joined.groupBy(F.lit("files").alias("finding"), F.col("file_asset_type").alias("key")),
        joined.where(F.col("missing_columns") != "").groupBy(
            F.lit("bad_header").alias("finding"), F.col("relative_file").alias("key")),
        joined.where(F.col("error") != "").groupBy(
            F.lit("unreadable").alias("finding"), F.col("relative_file").alias("key")),
        joined.where(~F.col("file_asset_type").isin(*MINUTE_ASSET_TYPES)).groupBy(
            F.lit("unknown_type").alias("finding"), F.col("relative_file").alias("key")),
    ]
    counted = [g.agg(F.count(F.lit(1)).alias("count")) for g in findings]
    repeated = sources.groupBy(F.lit("duplicate_symbol").alias("finding"),
                               F.col("file_symbol").alias("key")).agg(
        F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    parts = [*counted, repeated]
    if listed is not None:
        absent = listed.join(sources.select("relative_file"), "relative_file", "left_anti")
        parts.append(absent.groupBy(F.lit("missing_file").alias("finding"),
                                    F.col("relative_file").alias("key")).agg(
            F.count(F.lit(1)).alias("count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def normalise(parsed: DataFrame, frequency: str, convention: str = "source") -> DataFrame:
    """Canonical typed columns from parsed text rows; rows keep their position."""
    if frequency not in MINUTE_FREQUENCIES:
        raise ValueError(f"frequency must be one of {MINUTE_FREQUENCIES}")
    # Staged so that each derived text is computed once, not once per use.
    timed = parsed.withColumn("time_text", F.coalesce(
        N.join_date_and_clock(F.col("trade_date"), F.col("bar_time")), F.col("trade_date")))
    timed = timed.withColumn("bar_time", N.parse_time(F.col("time_text")))
    return timed.select(
        "unit", "member", "block", "pos",
        N.minute_symbol(F.col("symbol")).alias("symbol"),
        N.to_bar_end(F.col("bar_time"), frequency, convention).alias("bar_time"),
        *[N.to_number(F.col(name)).alias(name) for name in BAR_VALUES],
    )


def other_symbol() -> Column:
    """A row's symbol differs from the one its file claims; a file that claims none fits all."""
    return ~F.col("symbol").eqNullSafe(F.col("file_symbol")) & F.col("file_symbol").isNotNull()


def unparsable(check_symbol: bool) -> Column:
    """A key or a needed value could not be read."""
    needed = [F.col(c).isNull() for c in ("symbol", "bar_time", *OHLC, "volume")]
    bad = needed[0]
    for test in needed[1:]:
        bad = bad | test
    if check_symbol:
        bad = bad | ~F.coalesce(F.col("symbol").rlike(r"^\d{6}\.(SH|SZ|BJ)$"), F.lit(False))
    return bad


def out_of_order(rows: DataFrame) -> DataFrame:
    """Units with a time going backwards, found without ordering a whole file in one task.

    Order is checked inside each split; then only the first and last time of the splits of a
    series are compared. Members of an archive continue each other in name order and must not
    even share a time.
    """
    inside = Window.partitionBy("unit", "member", "symbol", "block").orderBy("pos")
    steps = rows.withColumn("before", F.lag("bar_time").over(inside))
    pieces = steps.groupBy("unit", "member", "symbol", "block").agg(
        F.count_if(F.col("bar_time") < F.col("before")).alias("backwards"),
        F.min("bar_time").alias("first_time"), F.max("bar_time").alias("last_time"),
    )
    across = Window.partitionBy("unit", "symbol").orderBy("member", "block").rowsBetween(
        Window.unboundedPreceding, -1)
    reached = F.max("last_time").over(across)
    same_member = F.lag("member").over(
        Window.partitionBy("unit", "symbol").orderBy("member", "block")) == F.col("member")
    late = F.when(same_member, F.col("first_time") < reached).otherwise(
        F.col("first_time") <= reached)
    return pieces.withColumn("late", F.coalesce(late, F.lit(False))).where(
        F.col("late") | (F.col("backwards") > 0)).select("unit").distinct()


def _judge(rows: DataFrame, collapse: bool) -> DataFrame:
    """Counts per unit that decide acceptance; all row tests are one aggregate."""
    facts = rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("rows_input"),
        *[F.count_if(name).alias(name) for name in ("unparsable", "symbol_mismatch", "off_grid", "illegal")],
        F.max("expected_rows").alias("expected_rows"),
    )
    keys = ["unit", "symbol", "bar_time"]
    usable = rows.where("usable").select(*keys, "values.*")
    # Extremes of every value combine before the shuffle without sorting; a null beside a value differs too.
    differs = F.lit(False)
    for name in BAR_VALUES:
        some = F.count(name)
        differs = differs | ((some > 0) & ((some < F.count(F.lit(1))) | (F.min(name) != F.max(name))))
    repeats = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), differs.alias("differs"))
    conflicts = repeats.where("differs" if collapse else "n > 1")
    conflicting = conflicts.groupBy("unit").agg(F.count(F.lit(1)).alias("conflicts"))
    return facts.join(conflicting, "unit", "left").na.fill(0, ["conflicts"])


def _marked(rows: DataFrame, frequency: str, check_symbol: bool) -> DataFrame:
    """What the verdicts need of every row: its key, its tests and its values."""
    bad, placeholder = unparsable(check_symbol), Q.opening_placeholder()
    sound = ~bad & ~placeholder
    return rows.select(
        "unit", "member", "block", "pos", "symbol", "bar_time", "expected_rows",
        bad.alias("unparsable"), sound.alias("usable"),
        other_symbol().alias("symbol_mismatch"),
        (sound & Q.off_grid(frequency)).alias("off_grid"),
        (sound & (Q.bad_ohlc() | Q.bad_amounts(rows))).alias("illegal"),
        F.struct(*BAR_VALUES).alias("values"),
    )


def _assemble(parse, formats: DataFrame, units: DataFrame, frequency: str, source: str,
              check_symbol: bool, collapse: bool, with_units: bool = False) -> Ingest:
    """Judge all units on the table of their typed rows, and take the accepted rows from it.

    ``parse`` turns formats into typed rows. They are parsed and stored once; a row is about as large as a digest of it.
    """
    rows = cut(parse(formats))
    marked = _marked(rows, frequency, check_symbol)
    usable = marked.where("usable").drop("values")
    single = keep_newest(usable, ["unit", "symbol", "bar_time"], ["block", "pos"]) if collapse \
        else usable
    written = single.groupBy("unit").agg(
        F.count(F.lit(1)).alias("rows_written"), F.min("bar_time").alias("min_time"),
        F.max("bar_time").alias("max_time"))
    judged = (
        units.join(_judge(marked, collapse), "unit", "left")
        .join(out_of_order(single).withColumn("unordered", F.lit(True)), "unit", "left")
        .join(written, "unit", "left")
    )
    zero = F.lit(0)
    count = {c: F.coalesce(c, zero) for c in (
        "rows_input", "unparsable", "symbol_mismatch", "off_grid", "illegal", "conflicts",
        "rows_written")}
    error = (
        F.when(F.col("error") != "", F.col("error"))
        .when(count["symbol_mismatch"] > 0, "symbol differs from the file's")
        .when(count["unparsable"] > 0, "unparsable rows")
        .when(count["conflicts"] > 0,
              "conflicting rows for one time" if collapse else "duplicate rows")
        .when(F.coalesce("unordered", F.lit(False)), "times not ascending")
        .when(count["off_grid"] > 0, "times outside the session grid")
        .when(count["illegal"] > 0, "illegal prices or amounts")
        .when(F.coalesce(F.col("expected_rows") != count["rows_input"], F.lit(False)),
              "row count differs from the manifest")
        .otherwise("")
    )
    status = F.when(error != "", "failed").when(count["rows_written"] == 0, "empty").otherwise(
        "success")
    report = judged.select(
        "unit", status.alias("status"), error.alias("reason"),
        count["rows_input"].alias("rows_input"),
        F.when(error == "", count["rows_written"]).otherwise(zero).alias("rows_written"),
        F.when(error == "", count["rows_input"] - count["rows_written"]).otherwise(zero)
        .alias("rows_filtered"),
        "min_time", "max_time",
    )
    report = cut(report)
    accepted = report.where(F.col("status") == "success").select("unit")
    rows = rows.join(accepted, "unit", "left_semi").where(~unparsable(check_symbol) & ~Q.opening_placeholder())
    if collapse:
        rows = keep_newest(rows, ["unit", "symbol", "bar_time"], ["block", "pos"])
    bars = rows.select(
        "symbol", "asset_type", F.lit(frequency).alias("frequency"),
        F.col("bar_time").cast("date").alias("trade_date"), "bar_time", *BAR_VALUES,
        N.is_auction(F.col("asset_type"), F.col("bar_time")).alias("is_auction"),
        F.lit(source).alias("source"),
        "unit",
    ).select(*MINUTE_COLUMNS, *(["unit"] if with_units else []))
    return Ingest(bars, report)


def import_directory(spark: SparkSession, root: str, frequency: str = "5min",
                     convention: str = "source", use_manifest: bool = False,
                     split_bytes: int = L.SPLIT_BYTES) -> Ingest:
    """Per-symbol CSV files: identical duplicates collapse, conflicting ones reject the file."""
    files = L.csv_files(spark, root).where(~F.col("member").endswith("/manifest.csv"))
    formats = cut(L.file_formats(files, split_bytes=split_bytes))
    listed = manifest(spark, root) if use_manifest else None
    sources = cut(directory_sources(formats, root, listed))
    headers = L.has_columns(formats, REQUIRED)
    claims = sources.select("member", "file_symbol", F.col("file_asset_type").alias("asset_type"),
                            "expected_rows")
    readable = formats.join(headers.where(F.col("missing_columns") == ""), "member", "left_semi").join(
        sources, "member", "left_semi")

    def parse(chosen: DataFrame) -> DataFrame:
        return normalise(L.parse_rows(chosen), frequency, convention).join(claims, "member")

    units = sources.join(headers, "member", "left").join(formats.select("member", "error"), "member").select(
        F.col("member").alias("unit"), _problem().alias("error"))
    return _assemble(parse, readable, units, frequency, "minute_directory", check_symbol=False, collapse=True)


def _problem() -> Column:
    return F.when(F.col("error") != "", F.col("error")).when(
        F.coalesce("missing_columns", F.lit("")) != "",
        F.concat(F.lit("missing columns: "), F.col("missing_columns"))).otherwise("")


def import_archives(spark: SparkSession, root: str, frequency: str = "1min",
                    asset_type: str = "auto", convention: str = "source") -> Ingest:
    """ZIP archives: any bad or repeated row rejects the whole archive."""
    return import_members(archive.zip_members(spark, root), frequency, asset_type, convention, "minute_zip")


def import_members(members: DataFrame, frequency: str, asset_type: str = "auto",
                   convention: str = "source", source: str = "minute_zip",
                   with_units: bool = False) -> Ingest:
    """Shared by archives and the streaming inbox; ``members`` carries (unit, member, entry, error)."""
    formats = cut(L.file_formats(members))
    headers = L.has_columns(formats, {"open", "high", "low", "close", "volume"})
    judged = formats.join(headers, "member").select("unit", _problem().alias("error"))
    units = judged.groupBy("unit").agg(F.max("error").alias("error"))
    readable = formats.join(units.where(F.col("error") == ""), "unit", "left_semi")

    def parse(chosen: DataFrame) -> DataFrame:
        named = L.parse_rows(chosen).withColumn("symbol", F.coalesce(
            "symbol", N.symbol_from_file_name(F.col("member"))))
        return normalise(named, frequency, convention).select(
            "*", N.minute_asset_type(F.col("symbol"), N.parent_folder(F.col("member")), asset_type)
            .alias("asset_type"),
            F.lit(None).cast("string").alias("file_symbol"),
            F.lit(None).cast("bigint").alias("expected_rows"),
        )

    return _assemble(parse, readable, units, frequency, source, check_symbol=True, collapse=False,
                     with_units=with_units)
