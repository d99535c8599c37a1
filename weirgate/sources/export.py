"""Delivery of a result in chunks of at most ``batch_size`` rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ConfigError

DEFAULT_BATCH = 512


def _check(batch_size: int) -> None:
    if batch_size <= 0:
        raise ConfigError("a batch has at least one row")


def export_batches(df: DataFrame, path: str, batch_size: int = DEFAULT_BATCH, file_format: str = "parquet") -> None:
    """Write files of at most ``batch_size`` rows; every task writes its own, the last one may be short."""
    _check(batch_size)
    df.write.format(file_format).option("maxRecordsPerFile", batch_size).mode("errorifexists").save(path)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch as one row of bytes."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def iter_batches(df: DataFrame, batch_size: int = DEFAULT_BATCH) -> Iterator[pa.RecordBatch]:
    """Hand rows to the driver program as Arrow batches of ``batch_size``; only the last may be short.

    The tasks do the encoding. The driver fetches one partition at a time, in order, and only cuts.
    """
    _check(batch_size)
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for row in df.mapInArrow(_encoded, "batch binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(row["batch"]):
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= batch_size:
            table = pa.Table.from_batches(waiting)
            whole = rows - rows % batch_size
            yield from _chunks(table.slice(0, whole), batch_size)
            waiting, rows = table.slice(whole).to_batches(), rows - whole
    if rows:
        yield from _chunks(pa.Table.from_batches(waiting), batch_size)


def _chunks(table: pa.Table, batch_size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, table.num_rows, batch_size):
        yield table.slice(start, batch_size).combine_chunks().to_batches()[0]
