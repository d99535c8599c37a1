from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import pivots, vector
from weirgate.operators.vector import QUERY_ID, _distances


def frames(spark, rows, queries):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "key long, v array<double>")
    asked = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in queries], f"{QUERY_ID} long, v array<double>")
    return df, asked


def brute(rows, queries, k, metric):
    keys, matrix = [i for i, v in rows if v is not None], np.array([v for _, v in rows if v is not None], float)
    out = {}
    for q, v in queries:
        if v is not None:
            found = sorted(zip(_distances(matrix, np.array(v, float), metric).tolist(), keys, strict=True))[:k]
            out[q] = [key for _, key in found], [d for d, _ in found]
    return out


def check(spark, rows, queries, k, metric):
    df, asked = frames(spark, rows, queries)
    got = {}
    for r in pivots.nearest_join(df, asked, "v", "key", k, metric).orderBy(QUERY_ID, "place").collect():
        got.setdefault(r[QUERY_ID], ([], []))
        assert r["place"] == len(got[r[QUERY_ID]][0]) + 1
        got[r[QUERY_ID]][0].append(r["key"])
        got[r[QUERY_ID]][1].append(r["distance"])
    want = brute(rows, queries, k, metric)
    assert set(got) == {q for q, found in want.items() if found[0]}
    for q, (keys, distances) in got.items():
        assert keys == want[q][0]
        assert np.allclose(distances, want[q][1], atol=1e-12)
    return df, asked


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12)) * 8
    rows = [(i, centres[i % 40] + 0.3 * rng.normal(size=12)) for i in range(4000)]
    queries = [(i, centres[i % 40] + 0.3 * rng.normal(size=12)) for i in range(200)]
    return rows, queries


@pytest.mark.parametrize("metric", vector.METRICS)
def test_against_all_pairs(spark, clustered, metric):
    check(spark, *clustered, 7, metric)


def test_few_cells_are_met(spark, clustered):
    df, asked = frames(spark, *clustered)
    met = pivots.meetings(df, asked, "v", "key", 5).count()
    cells = min(pivots.PIVOTS, int(4000**0.5))
    assert 200 <= met < 0.2 * 200 * cells


def test_many_queries_go_by_the_same_plan(spark, clustered, monkeypatch):
    rows, queries = clustered
    df, asked = frames(spark, rows, queries)
    few = vector.vector_search_batch(df, asked.limit(10), "v", "key", 3)
    many = vector.vector_search_batch(df, asked.crossJoin(spark.range(100)).select((F.col(QUERY_ID) * 100 + F.col("id")).alias(QUERY_ID), "v"), "v", "key", 3)
    shape = lambda d: [x.strip().split(" ")[0].lstrip("+- ") for x in d._jdf.queryExecution().optimizedPlan().treeString().split("\n") if "MapInArrow" in x or "RepartitionBy" in x]
    assert shape(few) == shape(many)
    want = brute(rows, queries, 3, "L2")
    got = {}
    for r in many.orderBy(QUERY_ID, "place").collect():
        got.setdefault(r[QUERY_ID], []).append(r["key"])
    assert len(got) == 20_000 and all(found == want[q // 100][0] for q, found in got.items())


def test_odd_rows(spark):
    zero = [0.0, 0.0]
    rows = [(1, [1, 0]), (2, [0, 1]), (3, zero), (4, None), (5, [1, 0]), (6, [-1, 0]), (7, [2, 0])]
    queries = [(0, [1, 0]), (1, zero), (2, None), (3, [5, 5])]
    for metric in vector.METRICS:
        for k in (1, 3, 50):
            check(spark, rows, queries, k, metric)
    df, asked = frames(spark, rows, queries)
    assert pivots.nearest_join(df, asked, "v", "key", 0).count() == 0
    assert pivots.nearest_join(df.where("false"), asked, "v", "key", 3).count() == 0
    assert pivots.nearest_join(df, asked.where("false"), "v", "key", 3).count() == 0


def test_a_third_of_all_rows_alike(spark, clustered, monkeypatch):
    rows, queries = clustered
    rows = rows[:600] + [(10_000 + i, rows[3][1]) for i in range(300)]
    # Small parts, so that the hot cell is cut.
    monkeypatch.setattr(pivots, "PART_FLOATS", 500)
    check(spark, rows, queries[:50], 5, "L2")
