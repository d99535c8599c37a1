from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgate.errors import InvalidRequest
from weirgate.operators import rollups

DAY = datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(8)
    rows = [(DAY + timedelta(minutes=rng.randrange(3 * 1440)), "get" if i % 3 else "list", rng.expovariate(1.0) if i % 50 else None) for i in range(20_000)]
    rows += [(None, "get", 1.0)]
    return rows, spark.createDataFrame(rows, "at timestamp_ntz, method string, seconds double")


def exact(rows, method, day):
    return sorted(s for t, m, s in rows if m == method and t is not None and t.date() == day.date() and s is not None)


def test_hours_and_late_calls_merge_to_days(spark, calls, tmp_path):
    rows, df = calls
    path = str(tmp_path / "hours")
    late = F.xxhash64("at", "seconds") % 7 == 0
    for part in (df.where(~late), df.where(late)):
        rollups.window_rollup(part, "at", "seconds", "1 hour", ["method"], buckets=(0.5, 2.0)).write.mode("append").parquet(path)
    days = rollups.with_quantiles(rollups.merge_rollups(spark.read.parquet(path), "1 day", ["method"]), [0.1, 0.5, 0.99]).collect()
    assert len(days) == 7
    for r in days:
        if r[rollups.START] is None:
            assert (r["requests_total"], r["duration_sum"]) == (1, 1.0)
            continue
        want = exact(rows, r["method"], r[rollups.START])
        every = [x for x in rows if x[0] is not None and x[1] == r["method"] and x[0].date() == r[rollups.START].date()]
        assert r["requests_total"] == len(every) and (r["duration_min"], r["duration_max"]) == (want[0], want[-1])
        assert r["duration_sum"] == pytest.approx(sum(want))
        assert r[rollups.BUCKETS] == [sum(s <= b for s in want) for b in (0.5, 2.0)]
        for q, value in zip((0.1, 0.5, 0.99), r["duration_quantiles"], strict=True):
            rank = sum(s <= value for s in want) / len(want)
            assert abs(rank - q) <= rollups.rank_error()


def test_merging_in_any_order_gives_the_same_counts(spark, calls):
    _, df = calls
    parts = [rollups.window_rollup(df.where(F.xxhash64("seconds") % 4 == i), "at", "seconds", "30 minutes", ["method"]) for i in (-3, -2, -1, 0, 1, 2, 3)]
    columns = [rollups.START, "method", "requests_total", "duration_min", rollups.BUCKETS]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    whole = rollups.window_rollup(df, "at", "seconds", "6 hours", ["method"])
    left = rollups.merge_rollups([rollups.merge_rollups(parts[:3], "1 hour", ["method"]), rollups.merge_rollups(parts[3:], "2 hours", ["method"])], "6 hours", ["method"])
    assert key(left) == key(whole) == key(rollups.merge_rollups(parts[::-1], "6 hours", ["method"]))


def test_small_groups_are_exact_and_odd_cases(spark):
    few = spark.createDataFrame([(DAY, "a", float(i)) for i in range(1, 6)] + [(DAY, "b", None)], "at timestamp_ntz, method string, seconds double")
    rows = {r["method"]: r for r in rollups.with_quantiles(rollups.window_rollup(few, "at", "seconds", "1 hour", ["method"]), [0.5]).collect()}
    assert rows["a"]["duration_quantiles"] == [3.0] and rows["b"]["duration_quantiles"] is None and rows["b"]["requests_total"] == 1
    assert rollups.merge_rollups(rollups.window_rollup(few.where("false"), "at", "seconds", "1 hour", ["method"]), "1 day", ["method"]).count() == 0
    for width in ("fortnight", "0 hours", "-1 day", "1 week"):
        with pytest.raises(InvalidRequest):
            rollups.window_rollup(few, "at", "seconds", width)
