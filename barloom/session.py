"""Session settings and the shared scratch location."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Result-affecting settings. Sizing (memory, cores, shuffle partitions) is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Top-k per group is trimmed inside every task before the shuffle for any realistic k.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # GB18030/GBK decoding of vendor CSV files (see sources.lines).
    "spark.sql.legacy.javaCharsets": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark 4.1; older versions ignore it


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("barloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master, where every task sees it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_base()
    path = f"{base.rstrip('/')}/barloom-{label}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


_MADE: list[str] = []  # scratch paths of this process


@cache
def _local_base() -> str:
    """One temporary folder of a local session, removed when the process ends."""
    base = tempfile.mkdtemp(prefix="barloom-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this process. Call it once the results that read them are written."""
    while _MADE:
        _delete(spark, _MADE.pop())


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``cut``; nothing may read them afterwards."""
    for frame in frames:
        _discard(frame)


def _discard(frame: DataFrame) -> None:
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("barloom-table-"):
            _delete(frame.sparkSession, folder)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame that several branches read, as a table in the shared folder.

    Lost executors cannot lose it, it is computed once, and unlike a checkpointed RDD it has file
    statistics, so later joins are planned on its real size. The shuffle files of the write go with it, as no other plan reads
    them: until the driver collects its garbage they would outlast many rounds.
    """
    path = scratch_path(frame.sparkSession, "table")
    conf = frame.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
