"""Nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt into shards of bounded size by a hash of their id. A shard's graph is built in
batches: greedy searches from a few entry points propose neighbours, and pruning keeps a candidate
only if no kept one is closer to it by the factor ``ALPHA`` than the point itself, which leaves
edges in many directions. Every query runs a beam search in every shard, queries in blocks; the
shards' best are merged. Distances of results are taken in double precision from the vectors as given.

Equal vectors of a shard are one node with all their ids, so a very common vector neither crowds out
edges nor hides others. Defined cases: rows with a null id and vectors that are null, empty, zero or
hold null or non-finite components take no part; vectors only meet those of their own length; a row
that is repeated counts once. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

# Out-edges of a node, candidates kept while building, and how much closer a kept edge must be.
DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
# Candidates kept while searching.
BEAM = 128
# Bytes of a shard's vectors; queries that go to a shard at once; points that are added at once.
SHARD_BYTES, QUERY_BLOCK, STEP = 8 << 20, 2048, 1024
ENTRIES = 16

INDEX = pa.schema(
    [("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("vectors", pa.binary()), ("edges", pa.binary()), ("entries", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]
)
INDEX_DDL = "dim int, shard int, n long, vectors binary, edges binary, entries binary, ids array<array<long>>"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


class Graph:
    """Points, their out-edges (-1: none) and the points where searches start."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> None:
        self.points, self.edges, self.entries = points, edges, entries
        self.small = points.astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.small, self.small)

    def _far(self, queries: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes."""
        dots = np.matmul(self.small[nodes], queries[:, :, None])[:, :, 0]
        return np.maximum(self.norms[nodes] - 2 * dots + own[:, None], 0)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points found for each query and their squared distances, nearest first."""
        queries = queries.astype(np.float32)
        own = np.einsum("ij,ij->i", queries, queries)
        n, rows = len(queries), np.arange(len(queries))[:, None]
        nodes = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        starts = self.entries[:beam]
        far[:, : len(starts)] = self._far(queries, own, np.broadcast_to(starts, (n, len(starts))))
        nodes[:, : len(starts)] = starts
        opened[:, : len(starts)] = False
        live = np.arange(n)
        while len(live):
            waiting = np.where(opened[live], np.inf, far[live])
            best = np.argsort(waiting, axis=1, kind="stable")[:, :2]
            found = np.take_along_axis(waiting, best, 1)
            going = np.isfinite(found[:, 0])
            live, best, found = live[going], best[going], found[going]
            if not len(live):
                break
            opened[live[:, None], best] = True
            sources = np.where(np.isfinite(found), nodes[live[:, None], best], -1)
            new = np.where(sources[:, :, None] >= 0, self.edges[np.maximum(sources, 0)], -1).reshape(len(live), -1)
            known = (new[:, :, None] == nodes[live][:, None, :]).any(2)
            new = np.sort(np.where(known, -1, new), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            away = self._far(queries[live], own[live], np.maximum(new, 0))
            away[new < 0] = np.inf
            all_far = np.concatenate((far[live], away), axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate((nodes[live], new), axis=1), order, 1)
            opened[live] = np.take_along_axis(np.concatenate((opened[live], away == np.inf), axis=1), order, 1)
        return nodes, far


def _prune(graph: Graph, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """The edges to keep of each point's candidates (-1: none): close ones, in different directions."""
    points = graph.small
    candidates = np.sort(np.where(candidates == own[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    far = graph._far(points[own], graph.norms[own], np.maximum(candidates, 0))
    far[candidates < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    theirs = points[np.maximum(candidates, 0)]
    norms = graph.norms[np.maximum(candidates, 0)]
    between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(theirs, theirs.transpose(0, 2, 1)), 0)
    alive = candidates >= 0
    kept = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for i in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, i] = candidates[rows, first][some]
        # Distances are squared, and so is the factor.
        covered = ALPHA * ALPHA * between[rows, first] <= far
        alive &= ~covered
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> Graph:
    """The graph of different points. Batches double in size, so that early points are searched often."""
    n = len(points)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    centre = int(np.argmin(((points - points.mean(0)) ** 2).sum(1))) if n else 0
    entries = np.unique(np.concatenate(([centre], order[: ENTRIES - 1]))) if n else np.zeros(0, np.int64)
    graph = Graph(points, np.full((n, degree), -1, np.int64), entries)
    at, done = 0, np.zeros(n, bool)
    done[entries] = True
    passes = [order, order]
    for turn, points_in_order in enumerate(passes):
        at = 0
        while at < n:
            to = min(n, at + min(STEP, max(16, at if not turn else STEP)))
            own = points_in_order[at:to]
            at = to
            near, _ = graph.search(graph.small[own], beam)
            old = graph.edges[own]
            graph.edges[own] = _prune(graph, own, np.concatenate((near, old), axis=1), degree)
            # Edges back: what no longer fits a node's list is pruned there as well.
            sources = np.repeat(own, degree)
            targets = graph.edges[own].ravel()
            sources, targets = sources[targets >= 0], targets[targets >= 0]
            by = np.argsort(targets, kind="stable")
            sources, targets = sources[by], targets[by]
            ends, first, count = np.unique(targets, return_index=True, return_counts=True)
            room = int(count.max()) if len(count) else 0
            for a in range(0, len(ends), STEP):
                some, f, c = ends[a : a + STEP], first[a : a + STEP], count[a : a + STEP]
                # More new edges than this to one node come in several turns.
                width = min(room, 3 * degree)
                for skip in range(0, int(c.max()), width):
                    take = skip + np.arange(width)[None, :]
                    new = np.where(take < c[:, None], sources[np.minimum(f[:, None] + take, len(sources) - 1)], -1)
                    asked = (new >= 0).any(1)
                    back, own_edges = new[asked], graph.edges[some[asked]]
                    graph.edges[some[asked]] = _prune(graph, some[asked], np.concatenate((own_edges, back), axis=1), degree)
    return graph


def _fit(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _points(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & _fit(F.col("vector"))).withColumn("dim", F.size("vector"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", *, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes an index of all vectors into a new folder: one row per shard."""
    # Equal rows are folded where they are, before any of them is dealt.
    points = written(_points(df, id_col, vector_col).distinct(), "vector-points")
    sizes = points.groupBy("dim").count().collect()  # one row per length of vectors
    total = {r["dim"]: max(1, -(-r["count"] * r["dim"] * 8 // shard_bytes)) for r in sizes}
    shards = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in total.items() for x in pair]), F.col("dim")), F.lit(1)) if total else F.lit(1)

    def shard_graph(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        vectors = _matrix(table.column("vector"), dim) + 0.0  # no negative zero
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1)))
        groups = [sorted(set(g.tolist())) for g in np.split(ids, np.flatnonzero(new)[1:])]
        graph = build(vectors[new])
        row = [[dim], [key[1].as_py()], [len(groups)], [graph.points.tobytes()], [graph.edges.astype(np.int32).tobytes()], [graph.entries.tobytes()], [groups]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, INDEX, strict=True)], schema=INDEX)

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), shards).cast("int"))
    dealt.groupBy("dim", "shard").applyInArrow(shard_graph, INDEX_DDL).write.parquet(path)


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", *, beam: int = BEAM
) -> DataFrame:
    """Each query's ``k`` nearest of the index but itself: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance)."""
    index = spark.read.schema(INDEX_DDL).parquet(path)
    asked = _points(queries, id_col, vector_col)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    asked = asked.join(F.broadcast(shards), "dim").withColumn("shard", F.explode("shards")).drop("shards")  # a number per shard
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def nearest(key: tuple[pa.Scalar, ...], own: pa.Table, block: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], f.type) for f in FOUND], schema=FOUND)
        if not own.num_rows or not block.num_rows:
            return empty
        row, dim = own.slice(0, 1).to_pylist()[0], key[0].as_py()
        points = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        graph = Graph(points, np.frombuffer(row["edges"], np.int32).astype(np.int64).reshape(len(points), -1), np.frombuffer(row["entries"], np.int64))
        ids = block.column("id").to_pylist()
        vectors = _matrix(block.column("vector"), dim)
        out: tuple[list, list, list] = [], [], []
        for a in range(0, len(ids), 256):
            near, _ = graph.search(vectors[a : a + 256], max(beam, 2 * k))
            for query, vector, found in zip(ids[a : a + 256], vectors[a : a + 256], near, strict=True):
                found = found[found >= 0]
                score = np.sqrt(((points[found] - vector) ** 2).sum(1))
                best = np.argsort(score, kind="stable")[: 2 * k + 2]
                # A node's ids are sorted: no more than k of them, next to the query's own, can be asked for.
                rows = [(s, v) for s, i in zip(score[best], found[best], strict=True) for v in row["ids"][i][: k + 1] if v != query]
                for s, v in sorted(rows)[:k]:
                    out[0].append(query)
                    out[1].append(v)
                    out[2].append(s)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND, strict=True)], schema=FOUND)

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest, FOUND_DDL)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
