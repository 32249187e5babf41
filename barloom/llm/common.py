"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# A batch handed to Python ends at whichever bound comes first; single longer rows still pass whole.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """Text as UTF-8 bytes; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b"").cast("binary"))


def quoted(name: str) -> str:
    """A column name that may hold dots, spaces and backticks, as Spark reads it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(frame: DataFrame, name: str = "row") -> Column:
    """All columns of a frame as one struct, whatever their names are."""
    return F.struct(*[F.col(quoted(column)) for column in frame.columns]).alias(name)


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def returning(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` for a group, then ``give_back``."""
    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return run


def map_batches(
    frame: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with bounded batches; ``work`` yields dictionaries of columns."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark_schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [_array(columns[field.name], field.type) for field in arrow], schema=arrow
            )
        give_back()

    return frame.mapInArrow(run, spark_schema)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).to_pylist()


def decoded(data: bytes) -> str:
    """Bytes that are not valid UTF-8 become the replacement character."""
    return data.decode("utf-8", "replace")
