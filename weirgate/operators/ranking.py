"""Ordered cuts: the first rows of an order, small or large."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import scratch_path

# Up to this many rows a per-task heap and one final merge are cheap; past it the rows stay spread out.
TOP_ROWS = 100_000

# Keys that are looked up as part of a filter, and how many of them one pushed list may hold.
LATE_KEYS = 200
PUSHED_KEYS = 10

ROW_ID = "__row_id"


def take_ordered(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order that has no ties.

    A small cut is a top-k: every task keeps its own first rows, and only those are merged. A large
    one is sorted by range over all tasks and written to the scratch folder; the row counts of the
    parts, one number per part, then tell where the cut begins and ends.
    """
    if limit <= 0:
        return df.limit(0)
    if offset + limit <= TOP_ROWS:
        cut = df.orderBy(*order)
        return (cut.offset(offset) if offset else cut).limit(limit)
    return _cut_sorted(df, order, limit, offset)


def key_filter(key: str, keys: Sequence[Any]) -> Column:
    """``key`` is one of ``keys``, in short lists: longer ones reach a file scan only as one wide range."""
    ordered = sorted(keys)
    chunks = [ordered[i : i + PUSHED_KEYS] for i in range(0, len(ordered), PUSHED_KEYS)]
    return reduce(lambda a, b: a | b, [F.col(key).isin(*chunk) for chunk in chunks])


def fetch_ordered(df: DataFrame, order: Sequence[Column], limit: int, key: str) -> DataFrame:
    """The first rows of an order, found by their unique key before they are read.

    One job runs at once, over the filter, sort and key columns only. The wide columns are then read
    for the found keys, where file statistics skip the rest. A longer cut is left to ``take_ordered``.
    """
    if not 0 < limit <= LATE_KEYS:
        return take_ordered(df, order, limit)
    found = [r[0] for r in take_ordered(df, order, limit).select(key).collect()]
    if not found:
        return df.limit(0)
    return df.where(key_filter(key, found)).orderBy(*order).limit(limit)


def _write_sorted(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, list[Row]]:
    """The rows, stored in order with an increasing id, and the row count of each sorted part.

    The generated id is ``(part << 33) + row in part``. It is written once, so it never changes again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    df.orderBy(*order).withColumn(ROW_ID, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy(F.shiftright(ROW_ID, 33).alias("part")).count().orderBy("part").collect()
    return stored, counts


def with_place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Number all rows from 1 in an order without ties, with no task seeing more than its own part."""
    stored, counts = _write_sorted(df, order)
    starts = accumulate((r["count"] for r in counts), initial=0)
    offsets = [(r["part"], start) for r, start in zip(counts, starts)]
    # one row per sorted part, so the broadcast is no larger than the number of tasks
    parts = df.sparkSession.createDataFrame(offsets, "__part long, __start long")
    numbered = stored.join(F.broadcast(parts), F.shiftright(ROW_ID, 33) == F.col("__part"))
    row = F.col(ROW_ID).bitwiseAND((1 << 33) - 1)
    return numbered.withColumn(name, F.col("__start") + row + 1).drop("__part", "__start", ROW_ID)


def _cut_sorted(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    stored, counts = _write_sorted(df, order)
    ends = list(accumulate(r["count"] for r in counts))

    def id_of(rank: int) -> int | None:
        """Generated id of the row with this many rows before it; None behind the end."""
        i = bisect_right(ends, rank)
        if i == len(ends):
            return None
        return (counts[i]["part"] << 33) + rank - (ends[i] - counts[i]["count"])

    first, behind = id_of(offset), id_of(offset + limit)
    if first is None:
        return df.limit(0)
    cut = stored.where(F.col(ROW_ID) >= first)
    if behind is not None:
        cut = cut.where(F.col(ROW_ID) < behind)
    return cut.orderBy(ROW_ID).drop(ROW_ID)
