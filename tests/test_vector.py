from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.errors import InvalidRequest
from weirgate.operators import pivots, vector

ROWS = [
    (1, "factuality", "What is the capital of France?", [0.1, 0.2, 0.3, 0.4]),
    (2, "reasoning", "Solve the bat and ball problem", [0.5, 0.6, 0.7, 0.8]),
    (3, "safety", "How do I pick a lock?", [0.9, 0.1, 0.2, 0.3]),
]


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(ROWS, "id long, category string, prompt string, embedding array<float>")


def ids(df):
    return [r["id"] for r in df.collect()]


def run(df, request, metric="L2"):
    return vector.vector_dispatch(df, json.dumps(request), "id", metric)


def test_query(prompts):
    out = run(prompts, {"collectionName": "c", "filter": "id > 0", "outputFields": ["id", "category", "prompt"], "limit": 100})
    assert out.columns == ["id", "category", "prompt"]
    assert sorted(ids(out)) == [1, 2, 3]
    assert ids(run(prompts, {"collectionName": "c", "limit": 0})) == []
    assert ids(run(prompts, {"collectionName": "c", "limit": -1})) == []
    assert ids(run(prompts, {"collectionName": "c", "offset": 1, "limit": 1})) == [2]
    assert sorted(ids(run(prompts, {"collectionName": "c", "offset": 2}))) == [3]
    assert ids(run(prompts, {"collectionName": "c", "offset": 9})) == []


def test_get(prompts):
    out = run(prompts, {"collectionName": "c", "id": [1, 3], "outputFields": ["id", "category", "prompt"]})
    assert sorted(ids(out)) == [1, 3]
    assert ids(run(prompts, {"collectionName": "c", "id": 2})) == [2]
    assert sorted(ids(vector.vector_get(prompts, list(range(2, 3000)), "id"))) == [2, 3]


def test_search(prompts):
    request = {"collectionName": "c", "data": [[0.1, 0.2, 0.3, 0.4], [9, 9, 9, 9]], "annsField": "embedding", "limit": 3, "outputFields": ["id", "category"]}
    out = run(prompts, request)
    assert out.columns == ["id", "category"]
    assert ids(out) == [1, 2, 3]
    assert ids(run(prompts, request | {"limit": 1})) == [1]
    assert ids(run(prompts, request | {"filter": "category in [\"safety\", 'x']"})) == [3]
    assert ids(run(prompts, request, "IP")) == [2, 1, 3]
    assert run(prompts, {k: v for k, v in request.items() if k != "outputFields"}).columns == ["category", "embedding", "id", "prompt"]
    assert ids(run(prompts, request | {"limit": 0})) == []


@pytest.mark.parametrize(
    "request_",
    [
        "nope", "{}", '{"collectionName": "c", "data": [[1]]}', '{"collectionName": "c", "id": []}',
        '{"collectionName": "c", "id": [1, "a"]}', '{"collectionName": "c", "id": ["a", 1]}', '{"collectionName": "c", "id": 1.5}',
        '{"collectionName": "c", "id": true}',
    ],
)
def test_bad_requests(request_):
    with pytest.raises(InvalidRequest):
        vector.parse_vector_request(request_)


def test_dispatch_order():
    parse = vector.parse_vector_request
    assert parse('{"collectionName": "c", "id": 1, "data": [[1.0]], "annsField": "v"}').operation == "search"
    assert parse('{"collectionName": "c", "id": "x"}').ids == ("x",)
    assert parse('{"collectionName": "c"}').operation == "query"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("id in [1, 2] && a == \"x && [y]\"", "id IN (1, 2)  AND  a == 'x && [y]'"),
        ("a[0] == 1 || b in ['p']", "a[0] == 1  OR  b IN ('p')"),
        ('name == "it\'s"', "name == 'it\\'s'"),
    ],
)
def test_filter_text(text, expected):
    assert vector.filter_text(text) == expected


def test_unknown_output_field(prompts):
    with pytest.raises(InvalidRequest):
        vector.order_fields(prompts, ["id", "nope"])


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 8)).astype("f4")
    points[100:300] = points[100]  # a third of the rows are copies of one vector
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(9999, None)]
    return points, spark.createDataFrame(rows, "id long, v array<float>").repartition(5)


def brute(points, queries, k, metric):
    points, queries = points.astype("f8"), np.asarray(queries, dtype="f8")
    out = set()
    for q, query in enumerate(queries):
        if metric == "L2":
            d = ((points - query) ** 2).sum(axis=1)
        elif metric == "IP":
            d = -(points @ query)
        else:
            d = 1 - (points @ query) / (np.linalg.norm(points, axis=1) * np.linalg.norm(query))
        order = sorted(range(len(points)), key=lambda i: (round(d[i], 9), i))[:k]
        out |= {(q, place, i) for place, i in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_batch_is_exact(cloud, metric):
    points, df = cloud
    queries = [list(map(float, p)) for p in points[[0, 100, 400]] + 0.25]
    got = vector.vector_search_batch(df, queries, "v", "id", 12, metric)
    assert {(r["query_id"], r["place"], r["id"]) for r in got.collect()} == brute(points, queries, 12, metric)


def test_many_queries_meet_parts_of_cells(spark, cloud, monkeypatch):
    """A query table is sent to the parts of the cells that it has to meet and gives the same rows."""
    points, df = cloud
    chosen = points[::3]
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(chosen)], "query_id long, v array<float>")
    monkeypatch.setattr(pivots, "PART_FLOATS", 8 * 50)
    got = vector.vector_search_batch(df, table, "v", "id", 5)
    assert {(r["query_id"], r["place"], r["id"]) for r in got.collect()} == brute(points, chosen, 5, "L2")


def test_a_collection_is_searched_with_itself(cloud, monkeypatch):
    points, df = cloud
    table = df.select(F.col("id").alias("query_id"), "v")
    monkeypatch.setattr(pivots, "PART_FLOATS", 8 * 100)
    got = vector.vector_search_batch(df, table, "v", "id", 2)
    assert {(r["query_id"], r["place"], r["id"]) for r in got.collect()} == brute(points, points, 2, "L2")


def test_cell_search(spark, cloud):
    points, df = cloud
    index = vector.build_cell_index(df, "v", "id", cells=12)
    assert sum(index.cells.values()) == len(points)
    queries = [list(map(float, p)) for p in points[[5, 100, 350, 590]]]
    want = brute(points, queries, 10, "L2")
    found = vector.vector_search_approx(spark, index, queries, 10, probe=6)
    hits = {(r["query_id"], r["id"]) for r in found.collect()}
    recall = len(hits & {(q, i) for q, _, i in want}) / len(want)
    assert recall >= 0.7
    whole = vector.vector_search_approx(spark, index, queries, 10, probe=12)
    assert {(r["query_id"], r["place"], r["id"]) for r in whole.collect()} == want
    # one small cell does not hold enough rows, so more cells are taken
    many = vector.vector_search_approx(spark, index, queries[:1], 550, probe=1)
    assert many.count() == 550


def test_only_probed_cells_are_read(spark, cloud):
    _, df = cloud
    index = vector.build_cell_index(df, "v", "id", cells=6)
    read = vector.read_cells(spark, index, [1, 4])
    assert {f.split("cell=")[1].split("/")[0] for f in read.inputFiles()} == {"1", "4"}
    assert read.count() == index.cells[1] + index.cells[4]
    assert vector.read_cells(spark, index, []).count() == 0


def test_an_index_is_opened_again_and_used(spark, cloud, tmp_path):
    points, df = cloud
    df = df.withColumn("even", F.col("id") % 2 == 0)
    vector.build_cell_index(df, "v", "id", cells=6, path=str(tmp_path / "index"))
    index = vector.open_cell_index(spark, str(tmp_path / "index"))
    request = {"collectionName": "c", "data": [points[5].tolist()], "annsField": "v", "filter": "even == true", "limit": 5, "outputFields": ["even", "id"]}
    exact = vector.vector_dispatch(df, request, "id").collect()
    found = vector.vector_dispatch(df, request, "id", index=index)
    assert found.columns == ["even", "id"]
    assert found.collect() == exact
    with pytest.raises(InvalidRequest):
        vector.vector_dispatch(df, request | {"annsField": "w"}, "id", index=index)


@pytest.mark.parametrize("metric", vector.METRICS)
def test_requests_miss_no_nearest_row_however_many_cells(spark, metric, tmp_path):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 12)).astype("f4")
    df = spark.createDataFrame([(i, p.tolist(), i % 100 == 0) for i, p in enumerate(points)], "id long, v array<float>, rare boolean")
    index = vector.build_cell_index(df, "v", "id", cells=60, path=str(tmp_path / "index"))
    for query, filter, limit in ((points[3], "", 10), (rng.normal(size=12) * 2, "", 25), (points[9], "rare == true", 6)):
        request = {"collectionName": "c", "data": [query.tolist()], "annsField": "v", "filter": filter, "limit": limit, "outputFields": ["id"]}
        exact = vector.vector_dispatch(df, request, "id", metric).collect()
        assert len(exact) == limit
        assert vector.vector_dispatch(df, request, "id", metric, index=index).collect() == exact


def test_cells_that_are_too_far_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(20, 8)) * 50
    rows = [(i, (middles[i % 20] + rng.normal(size=8)).tolist()) for i in range(800)]
    index = vector.build_cell_index(spark.createDataFrame(rows, "id long, v array<float>"), "v", "id", cells=20, path=str(tmp_path / "index"))
    assert len(vector._within(index, np.array(rows[0][1]), 30.0, "L2")) < 20


def test_an_empty_collection_is_indexed(spark, cloud):
    _, df = cloud
    index = vector.build_cell_index(df.where("false"), "v", "id")
    assert vector.vector_search_approx(spark, index, [[0.0] * index.centres.shape[1]], 3).count() == 0


def test_dimension_mismatch_fails(cloud):
    _, df = cloud
    with pytest.raises(Exception, match="dimensions"):
        vector.vector_search(df, [[1.0, 2.0]], "v", "id", 3).collect()


def test_late_reading_gives_the_same_rows(cloud):
    points, df = cloud
    wide = df.withColumn("text", F.concat(F.lit("t"), F.col("id")))
    query = [[float(x) for x in points[7]]]
    for limit in (1, 9, 300):
        for fields in (["text", "id"], ["id"], None):
            want = vector.vector_search(wide, query, "v", "id", limit, output_fields=fields).collect()
            assert vector.vector_search(wide, query, "v", "id", limit, output_fields=fields, late=True).collect() == want


def test_objects_come_as_text(spark):
    df = spark.sql("SELECT 1 id, array(1.0F, 2.0F) v, named_struct('a', 1, 'b', CAST(NULL AS INT)) meta")
    assert tuple(vector.order_fields(df).first()) == (1, '{"a":1,"b":null}', [1.0, 2.0])
