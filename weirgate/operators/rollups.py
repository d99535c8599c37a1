"""Roll-ups of calls per window that merge: to longer windows, and with calls that came late (C17).

A stored roll-up has, per window and group, the number of calls, the sum and the extremes of their durations, a histogram, and a
quantile sketch (KLL). All of those add up: a day is the merge of its hours, and late calls are rolled up on their own and merged
in, so calls are read once. Counts, sums, extremes and histograms are exact; a quantile's rank is off by at most about
``rank_error`` of the calls, and not at all while a sketch holds them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from .catalog import DURATION_BUCKETS

# Values that a sketch keeps on its lowest level; its error shrinks with it.
SKETCH_K = 400
START, SKETCH, BUCKETS = "window_start", "duration_sketch", "duration_buckets"


def rank_error(k: int = SKETCH_K) -> float:
    """A bound of a quantile's error as a share of the calls, that 99 of 100 sketches keep (published for KLL: 2.296 / k^0.9021)."""
    return 2.296 / k**0.9021


def window_rollup(
    calls: DataFrame, time: str, duration: str, width: str, by: Sequence[str] = ("method", "operation", "status"), *,
    buckets: Sequence[float] = DURATION_BUCKETS, k: int = SKETCH_K,
) -> DataFrame:
    """Calls rolled up per window of a ``width`` such as ``1 hour``, and group. A call without a time is in the window NULL, one without a
    duration is counted as a request only."""
    value = F.col(duration).cast("double")
    marked = calls.select(_start(F.col(time), width).alias(START), *by, value.alias("__value"))
    return marked.groupBy(START, *by).agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.sum("__value").alias("duration_sum"),
        F.min("__value").alias("duration_min"),
        F.max("__value").alias("duration_max"),
        F.array(*[F.count(F.when(F.col("__value") <= b, 1)) for b in buckets]).alias(BUCKETS),
        F.kll_sketch_agg_double("__value", F.lit(k)).alias(SKETCH),
    )


# Seconds of a unit.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def _start(time: Column, width: str) -> Column:
    """The start of the window that a time is in; windows are counted from 1970-01-01."""
    number, _, unit = width.partition(" ")
    if not number.isdigit() or int(number) < 1 or unit.rstrip("s") not in SECONDS:
        raise InvalidRequest(f"a window is a number of seconds, minutes, hours or days, not '{width}'")
    size = F.lit(int(number) * SECONDS[unit.rstrip("s")])
    seconds = F.unix_timestamp(time.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, size)).cast("timestamp_ntz")


def merge_rollups(parts: Sequence[DataFrame] | DataFrame, width: str | None = None, by: Sequence[str] = ("method", "operation", "status")) -> DataFrame:
    """Roll-ups added up: those of equal windows, or with a ``width`` those of all windows that begin in it."""
    rows = parts if isinstance(parts, DataFrame) else reduce(lambda a, b: a.unionByName(b), parts)
    if width is not None:
        rows = rows.withColumn(START, _start(F.col(START), width))
    lengths = rows.select(F.size(BUCKETS)).limit(1).collect()
    n = lengths[0][0] if lengths else 0
    return rows.groupBy(START, *by).agg(
        F.sum("requests_total").alias("requests_total"),
        F.sum("duration_sum").alias("duration_sum"),
        F.min("duration_min").alias("duration_min"),
        F.max("duration_max").alias("duration_max"),
        F.array(*[F.sum(F.element_at(BUCKETS, i + 1)) for i in range(n)]).cast("array<bigint>").alias(BUCKETS),
        F.kll_merge_agg_double(SKETCH).alias(SKETCH),
    )


def with_quantiles(rollup: DataFrame, quantiles: Sequence[float], name: str = "duration_quantiles") -> DataFrame:
    """The roll-up with an array of quantiles out of its sketches, NULL where no call had a duration."""
    found = F.array(*[F.kll_sketch_get_quantile_double(SKETCH, F.lit(float(q))) for q in quantiles])
    return rollup.withColumn(name, F.when(F.col("duration_min").isNotNull(), found))
