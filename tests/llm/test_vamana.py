from __future__ import annotations

import numpy as np
import pytest

from weirgate.llm.vamana import build_index, search_index
from weirgate.session import scratch_path


def brute(rows, k, every):
    found = {}
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q, v in good.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in good.items() if i != q and len(u) == len(v))[:k]
            found[q] = [(i, s) for s, i in near]
    return found


def search(spark, frame, k, every, **options):
    path = scratch_path(spark, "vector-graph")
    build_index(frame, path, **options)
    out = {}
    for r in search_index(spark, path, frame.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in frame.collect()], 10, 100)
    assert recall(search(spark, frame, 10, 100), want) >= 0.95


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60_000])
def test_recall_on_random_vectors_with_a_crowd(spark, shard_bytes):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    vectors += [(3000 + i, vectors[5][1]) for i in range(1500)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got, want = search(spark, frame, 10, 50, shard_bytes=shard_bytes), brute(vectors, 10, 50)
    assert recall(got, want) >= 0.95
    near = {q: dict(found) for q, found in want.items()}
    assert all(abs(near[q][i] - s) < 1e-9 for q, found in got.items() for i, s in found if i in near[q])
    # Ties go to the smaller id.
    assert [i for i, _ in got[3000]][:3] == [i for i, _ in want[3000]][:3] == [5, 3001, 3002]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, [-0.0, 5.0])]
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], "vec_id long, embedding array<double>, id string, shard int, dim int")
    got = search(spark, frame, 3, 2)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {0: [1, 10], 10: [0, 1]}
    assert search(spark, frame.where("false"), 3, 2) == {}


def test_a_frequent_id_is_folded_and_dealt_out(spark):
    rng = np.random.default_rng(2)
    one = lambda: [float(x) for x in rng.normal(size=8)]
    # 64 bytes a vector, so about 100 to a shard; id 1 has 1,000 of the 1,100 different rows.
    vectors = [(1, one()) for _ in range(1000)] + [(i, one()) for i in range(2, 102)]
    frame = spark.createDataFrame(vectors + [vectors[-1]] * 1100, "vec_id long, embedding array<double>")
    path = scratch_path(spark, "vector-graph")
    build_index(frame, path, shard_bytes=6400)
    sizes = [r[2] for r in spark.read.parquet(path).collect()]
    assert sum(sizes) == 1100 and len(sizes) <= 11 and max(sizes) < 200
