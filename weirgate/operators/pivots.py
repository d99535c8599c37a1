"""Exact nearest neighbours of a table of query vectors, by pivots and the triangle inequality (V5).

1. A bounded number of rows are pivots. Every row belongs to the cell of its nearest pivot; of each cell the number of rows,
   the nearest and the farthest distance to its pivot and the ``k`` smallest ones are known (numbers per cell, not per row).
2. A query is at most as far from a row as its way over the row's pivot. The ``k``-th smallest of those ways bounds
   how far its answers are, so it only has to meet cells that can have a row as near as that.
3. Cells are cut by a hash of the key into parts of bounded size. A task holds one part and streams the queries past it that
   have to meet it, keeping ``k`` rows of each; those are merged per query.

The same plan serves ten queries and millions: rows are shuffled once, queries once per part they meet. Cosine distances are
bounded on the unit sphere, inner products after one more dimension has made all rows equally long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import QUERY_ID, _as_matrix, _candidate_schema, _check, _merge_top, _top_kernel

# Pivots, at most; floats of a part of a cell; queries that meet a part at once.
PIVOTS, PART_FLOATS, QUERY_ROWS = 256, 2_000_000, 2048


def _space(metric: str, reach: float) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """How rows and queries are placed so that a smaller Euclidean distance is a nearer row."""
    if metric == "L2":
        return (lambda x: x), (lambda x: x)
    if metric == "IP":
        rows = lambda x: np.hstack((x, np.sqrt(np.maximum(0.0, reach**2 - np.einsum("ij,ij->i", x, x)))[:, None]))
        return rows, lambda x: np.hstack((x, np.zeros((len(x), 1))))

    def unit(x: np.ndarray) -> np.ndarray:
        # A vector of zeros is as far from all others as an orthogonal one.
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        return np.hstack((np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0), (size == 0)[:, None].astype(float)))

    return unit, unit


def _gaps(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2.0 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _slack(points: np.ndarray, pivots: np.ndarray) -> float:
    """What the rounding of a distance can be: the root of a difference of squares."""
    most = max(float(np.einsum("ij,ij->i", x, x).max(initial=0.0)) for x in (points, pivots))
    return float(np.sqrt(1e-12 * (1.0 + most)) * 4)


def _measured(place, pivots: np.ndarray, k: int):
    """Per task and cell: rows, the least, the greatest and the k smallest distances to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(len(pivots), "i8"), np.full(len(pivots), np.inf), np.zeros(len(pivots))
        least: list[np.ndarray] = [np.zeros(0)] * len(pivots)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows, _ = _as_matrix(batch.column(0).slice(at, 4096), _dims(batch.column(0)))
                gaps = _gaps(place(rows), pivots)
                cell = gaps.argmin(axis=1)
                own = gaps[np.arange(len(cell)), cell]
                for c in np.unique(cell):
                    mine = own[cell == c]
                    count[c] += len(mine)
                    low[c], high[c] = min(low[c], mine.min()), max(high[c], mine.max())
                    both = np.concatenate((least[c], mine))
                    least[c] = np.partition(both, k - 1)[:k] if len(both) > k else both
        some = np.flatnonzero(count)
        columns = [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(low[some]), pa.array(high[some]), pa.array([least[c].tolist() for c in some], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "low", "high", "least"])

    return run


def _dims(column: pa.Array) -> int:
    return column.value_lengths()[0].as_py() if len(column) else 0


class Cells:
    """Pivots in their space and what is known of their cells."""

    def __init__(self, pivots: np.ndarray, stats: list, k: int, dims: int) -> None:
        self.pivots, self.k = pivots, k
        self.n, self.low, self.high = np.zeros(len(pivots), "i8"), np.full(len(pivots), np.inf), np.zeros(len(pivots))
        least, of = [np.zeros(0)], [np.zeros(0, "i8")]
        for r in stats:
            self.n[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
            least.append(np.array(r["least"]))
            of.append(np.full(len(r["least"]), r["cell"]))
        self.least, self.of = np.concatenate(least), np.concatenate(of)
        self.parts = np.maximum(1, -(-self.n * dims // PART_FLOATS))

    def met(self, points: np.ndarray, unbounded: np.ndarray) -> np.ndarray:
        """Which cells each query has to meet."""
        gaps, slack = _gaps(points, self.pivots), _slack(points, self.pivots)
        ways = gaps[:, self.of] + self.least[None, :]
        enough = ways.shape[1] >= self.k
        reach = np.partition(ways, self.k - 1, axis=1)[:, self.k - 1] if enough else np.full(len(points), np.inf)
        reach = np.where(unbounded, np.inf, reach)
        nearest = np.maximum(gaps - self.high[None, :], self.low[None, :] - gaps)
        return (nearest <= reach[:, None] + 2 * slack) & (self.n > 0)[None, :]


def _assigned(place, cells: Cells):
    """Rows (key, vector) with their cell and its number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, "i8")]
            for at in range(0, batch.num_rows, 4096):
                rows, _ = _as_matrix(batch.column(1).slice(at, 4096), _dims(batch.column(1)))
                found.append(_gaps(place(rows), cells.pivots).argmin(axis=1))
            cell = np.concatenate(found)
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(cells.parts[cell], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "parts"])

    return run


def _meetings(place, cells: Cells, metric: str):
    """Queries (id, vector) with each cell that they have to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, _ = _as_matrix(some.column(1), _dims(some.column(1)))
                zero = (rows == 0).all(axis=1) if metric == "COSINE" else np.zeros(len(rows), bool)
                query, cell = np.nonzero(cells.met(place(rows), zero))
                taken = some.take(pa.array(query))
                columns = [*taken.columns, pa.array(cell, pa.int32()), pa.array(cells.parts[cell], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*some.schema.names, "cell", "parts"])

    return run


def _tiles(pk: str, k: int, metric: str):
    """Rows come part by part, those of the part first, then the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype("i8") for c in ("cell", "part", "kind")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))).tolist() if len(key) else []
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                if tuple(key[a, :2]) != at:
                    at, held, part = tuple(key[a, :2]), [], None
                own = batch.slice(a, b - a)
                if key[a, 2] == 0:
                    held.append(own.select([pk, "vector"]))
                    continue
                if held:
                    part, held = pa.Table.from_batches(held).combine_chunks().to_batches(), []
                if part is None:
                    continue
                for start in range(0, own.num_rows, QUERY_ROWS):
                    some = own.slice(start, QUERY_ROWS)
                    matrix, _ = _as_matrix(some.column("vector"), _dims(some.column("vector")))
                    yield from _top_kernel(pk, some.column(QUERY_ID).to_pylist(), matrix, k, metric)(iter(part))

    return run


def _cells_of(points: DataFrame, pk: str, k: int, metric: str) -> tuple[Cells, Callable, Callable] | None:
    spark = points.sparkSession
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, square, dims = points.agg(F.count(F.lit(1)), F.max(squares), F.max(F.size("vector"))).first()
    if not n:
        return None
    rows, queries = _space(metric, float(np.sqrt(square)) * (1 + 1e-9))
    wanted = int(min(PIVOTS, max(1, n**0.5)))
    # At most ``PIVOTS`` rows, picked by a hash of their key.
    picked = [r[0] for r in points.orderBy(F.xxhash64(pk), pk).limit(wanted).select("vector").collect()]
    pivots = rows(np.array(picked, "f8").reshape(len(picked), -1))
    ddl = "cell int, n long, low double, high double, least array<double>"
    stats = points.select("vector").mapInArrow(_measured(rows, pivots, k), ddl).groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k).alias("least"),
    )
    return Cells(pivots, stats.collect(), k, dims or 1), rows, queries  # at most k numbers per pivot


def _asked(queries: DataFrame, vector: str) -> DataFrame:
    return queries.where(F.col(vector).isNotNull()).select(F.col(QUERY_ID).cast("long").alias(QUERY_ID), F.col(vector).cast("array<double>").alias("vector"))


def meetings(df: DataFrame, queries: DataFrame, vector: str, pk: str, k: int, metric: str = "L2") -> DataFrame:
    """``(query_id, cell)``: what the join compares, for measuring it."""
    points = df.where(F.col(vector).isNotNull()).select(pk, F.col(vector).cast("array<double>").alias("vector"))
    cells, _, place = _cells_of(points, pk, k, metric)
    ddl = f"{QUERY_ID} long, vector array<double>, cell int, parts int"
    return _asked(queries, vector).mapInArrow(_meetings(place, cells, metric), ddl).select(QUERY_ID, "cell")


def nearest_join(df: DataFrame, queries: DataFrame, vector: str, pk: str, k: int, metric: str = "L2") -> DataFrame:
    """``(query_id, <pk>, distance, place)``: the exact k nearest rows of each row of ``queries(query_id, <vector>)``."""
    _check(k, metric)
    schema = _candidate_schema(df, pk)
    points = df.where(F.col(vector).isNotNull()).select(pk, F.col(vector).cast("array<double>").alias("vector"))
    known = _cells_of(points, pk, k, metric) if k else None
    if known is None:
        return df.sparkSession.createDataFrame([], schema).withColumn("place", F.lit(0))
    cells, rows_place, queries_place = known
    kind = schema[pk].dataType.simpleString()
    rows = points.mapInArrow(_assigned(rows_place, cells), f"`{pk}` {kind}, vector array<double>, cell int, parts int")
    rows = rows.select("cell", F.pmod(F.xxhash64(pk), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.col(pk), F.lit(None).cast("long").alias(QUERY_ID), "vector")
    asked = _asked(queries, vector).mapInArrow(_meetings(queries_place, cells, metric), f"{QUERY_ID} long, vector array<double>, cell int, parts int")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("cell", "part", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias(pk), QUERY_ID, "vector")
    together = rows.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return _merge_top(together.mapInArrow(_tiles(pk, k, metric), schema), pk, k)
