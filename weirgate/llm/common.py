"""Helpers the operators of this subpackage share: written tables, Arrow columns, task memories."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Bytes of text that one vectorised step works on; NumPy needs some tens of bytes for each.
STEP_BYTES = 1 << 20
# Bytes of rows that Spark hands to a Python worker at once. The executor has as many again outside its heap, per task and until the buffers are reused.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


# The tables written on the way to a result that ``alone`` is making.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Queries that run meanwhile hand rows to Python workers in batches of about ``size`` bytes."""
    before = spark.conf.get(BATCH_KEY) if BATCH_KEY in spark.conf.getAll else None
    spark.conf.set(BATCH_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame, name: str, batch: int = BATCH_BYTES) -> DataFrame:
    """The rows as a table in the shared scratch folder, which cuts the lineage. Python steps on the way get ``batch`` bytes at once."""
    path = scratch_path(df.sparkSession, name)
    if (tables := _ON_THE_WAY.get()) is not None:
        tables.append(path)
    with batches_of(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that ``make`` gives, written; the tables that it wrote on the way there go, as nothing reads them any more."""
    tables: list[str] = []
    token = _ON_THE_WAY.set(tables)
    try:
        found = make()
        _ON_THE_WAY.reset(token)
        token = None
        return written(found, name)
    finally:
        if token is not None:
            _ON_THE_WAY.reset(token)
        for table in tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(total: int, each: int, least: int) -> int:
    """How many partitions hold ``total`` in shares of ``each``."""
    return max(least, -(-int(total or 0) // each))


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """A number for each row. It follows how the rows are dealt to tasks, so it holds only for one run of the plan: write it to use it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def task_number() -> int:
    """The partition this task works on."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def once(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for later tasks of the same Python worker."""
    memory = sys.modules.setdefault("_weirgate_memory", types.ModuleType("_weirgate_memory"))
    kept = memory.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on, and the C library keeps what one task needed for the next one."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The step of a task between two calls of ``give_back``: what tasks before it left goes first, and what it needed goes at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one after the other, and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def rows_out(schema: pa.Schema, columns: list[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
