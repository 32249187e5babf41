"""ZIP archives of CSV members: tasks read the central directories, members are then spread over the cluster."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barloom.sources.lines import csv_files

# --- fixed values: limits on archive members ---
MAX_MEMBER_BYTES = 5 * 1024**3
MAX_RATIO = 500

# Reasons to refuse a member, each with its test of (path, packed size, full size).
MEMBER_RULES = (
    ("suspicious compression ratio", lambda path, packed, full: full > MAX_RATIO * max(packed, 1)),
    ("member too large", lambda path, packed, full: full > MAX_MEMBER_BYTES),
    ("unsafe path", lambda path, packed, full: path.is_absolute() or ".." in path.parts),
)


def archive_entries(archive: zipfile.ZipFile) -> tuple[list[tuple[str, int]], str]:
    """Names and sizes of the CSV members in order, and the first reason to refuse the archive."""
    members = [(PurePosixPath(i.filename), i.compress_size, i.file_size) for i in archive.infolist()]
    reasons = {reason for reason, broken in MEMBER_RULES if any(broken(*member) for member in members)}
    names = sorted((i.filename, i.file_size) for i in archive.infolist()
                   if i.filename.lower().endswith(".csv") and not i.is_dir())
    if len({name for name, _ in names}) < len(names):
        reasons.add("duplicate members")
    elif not names:
        reasons.add("no CSV member")
    order = ["unsafe path", "member too large", "suspicious compression ratio", "duplicate members",
             "no CSV member"]
    return names, next((reason for reason in order if reason in reasons), "")


def expanded(archives: DataFrame) -> DataFrame:
    """(unit, member, entry, error, size): CSV members of every archive; a bad archive is one error row."""

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for unit in batch["unit"]:
                try:
                    system, inner = fs.FileSystem.from_uri(unit)
                    with system.open_input_file(inner) as handle, zipfile.ZipFile(handle) as archive:
                        names, error = archive_entries(archive)
                except (OSError, ValueError, zipfile.BadZipFile) as exc:
                    names, error = [], f"unreadable archive: {type(exc).__name__}"
                if error:
                    names = [("", 0)]
                yield pd.DataFrame({"unit": unit, "member": [f"{unit}!/{name}" for name, _ in names],
                                    "entry": [name for name, _ in names], "error": error, "size": [size for _, size in names]})

    return archives.select("unit").repartition("unit").mapInPandas(
        inspect, "unit string, member string, entry string, error string, size bigint")


def zip_members(spark: SparkSession, root: str) -> DataFrame:
    """Members of every archive below ``root``, in the shape of ``csv_files``."""
    return expanded(csv_files(spark, root, "*.zip"))
