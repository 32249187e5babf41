"""Polled inbox as a file stream: every run imports the CSV and ZIP files that arrived since the last one.

Spark's checkpoint remembers the files. A batch is judged file by file: a file that is broken, or that disagrees
with stored bars or with another file of its batch, is reported and left out; the others are merged. A batch that
is repeated after a failure replaces its own report and merges the same rows again, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.session import cut
from barloom.sources import archive, ingest, store
from barloom.sources.lines import decoded_path


def _arrivals(spark: SparkSession, inbox: str) -> DataFrame:
    """Stream of the names and sizes of new files."""
    return (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,zip,CSV,ZIP}")
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(inbox)
        .select(decoded_path(F.col("path")).alias("unit"), F.col("length").alias("size"))
    )


def members_of(units: DataFrame) -> DataFrame:
    """(unit, member, entry, error, size): CSV files as they are, archives by their members."""
    zipped = F.lower("unit").endswith(".zip")
    plain = units.where(~zipped).select("unit", F.col("unit").alias("member"), F.lit("").alias("entry"),
                                        F.lit("").alias("error"), "size")
    return plain.unionByName(archive.expanded(units.where(zipped)))


def import_new_files(spark: SparkSession, inbox: str, store_root: str, checkpoint: str,
                     frequency: str = "1min", report_root: str | None = None) -> None:
    """One polling run: accepted files are merged into the store, verdicts are kept by batch."""

    def merge(batch: DataFrame, number: int) -> None:
        units = cut(batch)
        result = ingest.import_members(members_of(units), frequency, source="minute_inbox", with_units=True)
        bars = cut(result.bars)
        clashes = cut(store.clashing_units(bars, store_root))
        if report_root:
            clash = clashes.withColumn("clash", F.lit(True))
            clashed = F.coalesce("clash", F.lit(False)) & (F.col("status") == "success")
            (
                result.report.join(clash, "unit", "left").withColumns({
                    "reason": F.when(clashed, "bars conflict with other bars").otherwise(F.col("reason")),
                    "rows_written": F.when(clashed, 0).otherwise(F.col("rows_written")),
                    "status": F.when(clashed, "failed").otherwise(F.col("status")),
                }).drop("clash").withColumn("batch", F.lit(number))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch").parquet(report_root)
            )
        store.merge_minute(bars.join(clashes, "unit", "left_anti").drop("unit"), store_root)

    query = (
        _arrivals(spark, inbox).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
