from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import codes, vector
from weirgate.operators.vector import _distances


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    points = (centres[np.arange(6000) % 30] + 0.6 * rng.normal(size=(6000, 32))).astype("f4")
    rows = [(i, [float(x) for x in p], i % 7) for i, p in enumerate(points)] + [(9999, None, 0)]
    return points, spark.createDataFrame(rows, "id long, v array<float>, label int")


@pytest.fixture(scope="module")
def index(spark, cloud, tmp_path_factory):
    return codes.build_code_index(cloud[1], "v", "id", str(tmp_path_factory.mktemp("codes") / "i"))


def nearest(points, query, k, metric, allowed=None):
    d = _distances(points.astype("f8"), query, metric)
    order = np.lexsort((np.arange(len(points)), d))
    return [int(i) for i in order if allowed is None or allowed(i)][:k]


@pytest.mark.parametrize("metric", vector.METRICS)
def test_recall_of_the_short_list(spark, cloud, index, metric):
    points, _ = cloud
    queries = points[::400].astype("f8") + 0.1
    hits = total = 0
    got = codes.vector_search_codes(spark, codes.open_code_index(spark, index.path), queries.tolist(), 10, metric, output_fields=["label"]).collect()
    for i, q in enumerate(queries):
        own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, 11)) and all(r["label"] == r["id"] % 7 for r in own)
        assert np.allclose([r["distance"] for r in own], _distances(points[[r["id"] for r in own]].astype("f8"), q, metric))
        want = nearest(points, q, 10, metric)
        hits, total = hits + len(set(want) & {r["id"] for r in own}), total + 10
    assert hits / total >= 0.9


def test_filters_are_applied_to_codes(spark, cloud, index):
    points, _ = cloud
    got = codes.vector_search_codes(spark, index, [points[3].tolist()], 5, filter="label == 4", shortlist=1000).orderBy("place").collect()
    assert [r["id"] for r in got] == nearest(points, points[3].astype("f8"), 5, "L2", lambda i: i % 7 == 4)


def test_a_whole_short_list_is_exact(spark, cloud, index):
    points, _ = cloud
    queries = points[:2].tolist()
    for rows in (codes.vector_search_codes(spark, index, queries, 20, shortlist=6000), codes.vector_search_codes(spark, index, queries[:1], 20, shortlist=1900)):
        got = rows.orderBy("query_id", "place").collect()
        for i in {r["query_id"] for r in got}:
            assert [r["id"] for r in got if r["query_id"] == i] == nearest(points, np.array(queries[i]), 20, "L2")


def test_odd_tables(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, None)], "id long, v array<double>")
    index = codes.build_code_index(few, "v", "id", str(tmp_path / "few"))
    assert [r["id"] for r in codes.vector_search_codes(spark, index, [[1.0, 2.0, 3.9]], 5).orderBy("place").collect()] == [2, 1]
    assert codes.vector_search_codes(spark, index, [[1.0, 2.0, 3.9]], 0).count() == 0
    empty = codes.build_code_index(few.where("false"), "v", "id", str(tmp_path / "empty"))
    assert codes.vector_search_codes(spark, empty, [[1.0]], 5).count() == 0


def test_under_a_tenth_of_the_vector_bytes_is_read(spark, tmp_path):
    """Bytes that the local file system hands out, of 120,000 vectors of 256 bytes."""
    rng = np.random.default_rng(6)
    n, dims = 120_000, 64
    points = rng.normal(size=(n, dims)).astype("f4") * np.linspace(2, 0.2, dims).astype("f4")
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(points.ravel(), dims).cast(pa.list_(pa.float32()))}), tmp_path / "p.parquet")
    index = codes.build_code_index(spark.read.parquet(str(tmp_path / "p.parquet")), "v", "id", str(tmp_path / "i"), sample=20_000)
    files = spark._jvm.org.apache.hadoop.fs.FileSystem

    def read():
        every = files.getAllStatistics()
        return sum(every.get(i).getBytesRead() for i in range(every.size()) if every.get(i).getScheme() == "file")

    hits, share = 0, []
    for i in range(0, n, n // 8):
        before = read()
        got = {r["id"] for r in codes.vector_search_codes(spark, index, [points[i].tolist()], 10).collect()}
        share.append((read() - before) / (n * dims * 4))
        hits += len(got & set(nearest(points, points[i].astype("f8"), 10, "L2")))
    assert hits / 80 >= 0.9
    assert max(share) < 0.1, share
