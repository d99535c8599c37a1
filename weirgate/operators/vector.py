"""Vector collections: scalar queries, lookups, and nearest neighbours (V1-V7).

A collection is a DataFrame with a unique primary key and one array<float> column. Distances are
computed in batches of rows by NumPy inside Spark tasks; a task hands on at most ``k`` rows per query
vector, never the pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest
from ..functions.types import stringify
from ..session import scratch_path
from .ranking import LATE_KEYS, key_filter, take_ordered

METRICS = ("L2", "IP", "COSINE")
# Fixed value: rows of a search that sets no limit.
DEFAULT_SEARCH_LIMIT = 10
# Rows of a finished result whose keys are looked up by a broadcast.
BROADCAST_ROWS = 100_000
# Queries that one matrix product covers.
QUERY_BLOCK = 256

QUERY_ID, DISTANCE = "query_id", "distance"
# The column of an index that names a row's cell, and the folders of its rows and centres.
CELL, ROWS, CENTRES = "index_cell", "rows", "centres"
# Cells that a search reads to learn how far its nearest rows are.
FIRST_CELLS = 8


# -- requests ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorRequest:
    """A parsed vector-store request."""

    collection: str
    operation: str
    filter: str = ""
    output_fields: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int = 0
    data: tuple[tuple[float, ...], ...] = ()
    anns_field: str | None = None
    ids: tuple[Any, ...] = ()


def parse_vector_request(text: str | Mapping[str, Any]) -> VectorRequest:
    """Vectors make it a search, else an id a get, else it is a query."""
    try:
        body = json.loads(text) if isinstance(text, str) else dict(text)
        name = body["collectionName"]
    except (ValueError, KeyError, TypeError) as error:
        raise InvalidRequest(f"the vector request cannot be read: {error}") from error
    data, ids = body.get("data"), body.get("id")
    operation = "search" if data is not None else "get" if ids is not None else "query"
    if operation == "search" and not body.get("annsField"):
        raise InvalidRequest("a search names its vector field in annsField")
    fields = body.get("outputFields")
    return VectorRequest(
        collection=name,
        operation=operation,
        filter=body.get("filter") or "",
        output_fields=tuple(fields) if fields is not None else None,
        limit=body.get("limit"),
        offset=body.get("offset") or 0,
        data=tuple(tuple(float(x) for x in v) for v in data or ()),
        anns_field=body.get("annsField"),
        ids=parse_ids(ids) if operation == "get" else (),
    )


def parse_ids(value: Any) -> tuple[Any, ...]:
    """One id or a list of ids, all whole numbers or all strings."""
    ids = value if isinstance(value, list) else [value]
    if not ids:
        raise InvalidRequest("the list of ids is empty")
    whole = [isinstance(i, int) and not isinstance(i, bool) for i in ids]
    if isinstance(ids[0], (int, float)) and not isinstance(ids[0], bool):
        if not all(whole):
            raise InvalidRequest("ids must be all whole numbers or all strings")
    elif not all(isinstance(i, str) for i in ids):
        raise InvalidRequest("ids must be all whole numbers or all strings")
    return tuple(ids)


_FILTER_PARTS = re.compile(
    r"""(?P<double>"(?:[^"\\]|\\.)*") | (?P<single>'(?:[^'\\]|\\.)*')
      | (?P<open>\bin\s*\[) | (?P<close>\]) | (?P<sub>\[) | (?P<op>&&|\|\|)""",
    re.IGNORECASE | re.VERBOSE,
)


def filter_text(text: str) -> str:
    """A scalar filter as Spark SQL: ``in [1, 2]``, ``&&``, ``||`` and double-quoted text are rewritten."""
    closers: list[str] = []

    def rewrite(match: re.Match[str]) -> str:
        found = match.group()
        if match["double"]:
            inner = found[1:-1].replace('\\"', '"').replace("'", "\\'")
            return f"'{inner}'"
        if match["open"]:
            closers.append(")")
            return "IN ("
        if match["sub"]:
            closers.append("]")
        if match["close"]:
            return closers.pop() if closers else found
        if match["op"]:
            return " AND " if found == "&&" else " OR "
        return found

    return _FILTER_PARTS.sub(rewrite, text)


def vector_dispatch(
    df: DataFrame,
    request: str | Mapping[str, Any] | VectorRequest,
    pk: str,
    metric: str = "L2",
    late: bool = False,
    index: CellIndex | Any | None = None,
) -> DataFrame:
    """Run a request on its collection: search, get or query. With a cell index, searches read the cells that can have a nearest row; with
    a code index (see ``codes``) they read codes and a short list."""
    r = request if isinstance(request, VectorRequest) else parse_vector_request(request)
    if r.operation == "search":
        limit = DEFAULT_SEARCH_LIMIT if r.limit is None else r.limit
        if index is not None:
            if (r.anns_field, pk) != (index.vector, index.pk):
                raise InvalidRequest(f"the index is on '{index.vector}' by '{index.pk}'")
            fields = list(r.output_fields) if r.output_fields is not None else sorted(df.columns)
            if isinstance(index, CellIndex):
                found = vector_search_approx(df.sparkSession, index, r.data[:1], limit, None, metric, r.filter, fields)
            else:
                from .codes import vector_search_codes

                found = vector_search_codes(df.sparkSession, index, r.data[:1], limit, metric, r.filter, fields)
            return order_fields(found.orderBy(DISTANCE, pk), fields)
        return vector_search(df, r.data, r.anns_field, pk, limit, metric, r.filter, r.output_fields, late)
    if r.operation == "get":
        return vector_get(df, r.ids, pk, r.output_fields)
    return vector_query(df, pk, r.filter, r.output_fields, r.offset, r.limit)


# -- scalar access -----------------------------------------------------------------------------


def order_fields(df: DataFrame, output_fields: Sequence[str] | None = None, extras: Sequence[str] = ()) -> DataFrame:
    """Asked fields in the asked order, then extras; without a list all fields sorted by name.

    Objects come as JSON text, vectors as arrays.
    """

    def shown(name: str) -> Column:
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        nested = isinstance(kind, (T.StructType, T.MapType, T.VariantType))
        return stringify(column, kind).alias(name) if nested else column

    if output_fields is None:
        return df.select(*[shown(c) for c in sorted(df.columns)])
    missing = [c for c in output_fields if c not in df.columns]
    if missing:
        raise InvalidRequest(f"unknown output fields: {missing}")
    names = list(dict.fromkeys([*output_fields, *extras]))
    return df.select(*[shown(c) for c in names])


def _filtered(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.expr(filter_text(text))) if text.strip() else df


def vector_query(
    df: DataFrame,
    pk: str,
    filter: str = "",
    output_fields: Sequence[str] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Rows that pass a scalar filter. A limit of zero or less gives none, no limit gives all.

    Offset and limit count in primary-key order.
    """
    rows = _filtered(df, filter)
    if limit is not None:
        rows = take_ordered(rows, [F.col(pk).asc()], limit, offset)
    elif offset:
        rows = _skip_first(rows, pk, offset)
    return order_fields(rows, output_fields)


def _skip_first(df: DataFrame, pk: str, offset: int) -> DataFrame:
    """All rows but the first ``offset`` in key order: only the boundary key has to be found."""
    boundary = take_ordered(df.select(pk), [F.col(pk).asc()], 1, offset - 1).collect()
    return df.where(F.col(pk) > F.lit(boundary[0][0])) if boundary else df.limit(0)


def vector_get(
    df: DataFrame, ids: Sequence[Any] | DataFrame, pk: str, output_fields: Sequence[str] | None = None
) -> DataFrame:
    """Rows by primary key. A short list is a filter the scan can use; a table of keys is a semi join."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias(pk))
    else:
        known = parse_ids(list(ids))
        if len(known) <= LATE_KEYS:
            return order_fields(df.where(key_filter(pk, known)), output_fields)
        keys = df.sparkSession.createDataFrame([(k,) for k in known], T.StructType([df.schema[pk]]))
    return order_fields(df.join(keys, pk, "left_semi"), output_fields)


# -- nearest neighbours ------------------------------------------------------------------------


def _distances(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to one query vector; smaller is nearer for every metric."""
    if metric == "L2":
        gap = rows - query
        return np.einsum("ij,ij->i", gap, gap)
    products = np.einsum("ij,j->i", rows, query)
    if metric == "IP":
        return -products
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.dot(query, query))
    return 1.0 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)


def _rough_distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """All rows against all queries in one matrix product, and a bound of its rounding error."""
    products = rows @ queries.T
    row_squares, query_squares = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", queries, queries)
    size = float(row_squares.max(initial=0.0) + query_squares.max(initial=0.0))
    if metric == "L2":
        return row_squares[:, None] + query_squares[None, :] - 2.0 * products, 1e-9 * size
    if metric == "IP":
        return -products, 1e-9 * size
    norms = np.sqrt(row_squares)[:, None] * np.sqrt(query_squares)[None, :]
    return 1.0 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0), 1e-9


def _nearest(distances: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest, equal distances in key order."""
    if len(distances) > k:
        border = np.partition(distances, k - 1)[k - 1]
        kept = np.nonzero(distances <= border)[0]
    else:
        kept = np.arange(len(distances))
    return kept[np.lexsort((keys[kept], distances[kept]))[:k]]


def _as_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a float64 matrix, and which rows have one; a row without is left out."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(dims).to_numpy(zero_copy_only=False)
    if (lengths != dims).any():
        raise ValueError(f"a vector does not have {dims} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype("f8"), present


def _top_kernel(
    pk: str,
    query_ids: Sequence[int],
    queries: np.ndarray,
    k: int,
    metric: str,
    probes: Sequence[frozenset[int]] | None = None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per-task top ``k`` of each query over batches of (key, vector[, cell])."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray | None]] = [(np.empty(0), None)] * len(queries)
        key_type = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_type = batch.column(0).type
            rows, present = _as_matrix(batch.column(1), queries.shape[1])
            keys = batch.column(0).to_numpy(zero_copy_only=False)[present]
            cells = batch.column(2).to_numpy(zero_copy_only=False)[present] if probes else None
            for start in range(0, len(queries), QUERY_BLOCK):
                block = queries[start : start + QUERY_BLOCK]
                rough, error = _rough_distances(rows, block, metric)
                for i, query in enumerate(block, start):
                    near = np.isin(cells, list(probes[i])) if probes else None
                    best[i] = _improve(best[i], rows, keys, query, rough[:, i - start], error, near, k, metric)
        if key_type is None:
            return
        for query_id, (found, found_keys) in zip(query_ids, best):
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), query_id, dtype="i8")),
                        pa.array(found_keys, type=key_type),
                        pa.array(found),
                    ],
                    names=[QUERY_ID, pk, DISTANCE],
                )

    return kernel


def _improve(
    best: tuple[np.ndarray, np.ndarray | None],
    rows: np.ndarray,
    keys: np.ndarray,
    query: np.ndarray,
    rough: np.ndarray,
    error: float,
    near: np.ndarray | None,
    k: int,
    metric: str,
) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` so far with a batch of rows taken in.

    Rough distances only rule out rows that cannot be among them; the others are measured exactly.
    """
    known, known_keys = best
    allowed = rough if near is None else rough[near]
    limit = np.partition(allowed, k - 1)[k - 1] if len(allowed) > k else np.inf
    if len(known) == k:
        limit = min(limit, known[-1])
    possible = rough <= limit + 2.0 * error
    if near is not None:
        possible &= near
    found, found_keys = _distances(rows[possible], query, metric), keys[possible]
    if known_keys is not None:
        found, found_keys = np.concatenate([known, found]), np.concatenate([known_keys, found_keys])
    top = _nearest(found, found_keys, k)
    return found[top], found_keys[top]


def _candidate_schema(df: DataFrame, pk: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(QUERY_ID, T.LongType()),
            T.StructField(pk, df.schema[pk].dataType),
            T.StructField(DISTANCE, T.DoubleType()),
        ]
    )


def _merge_top(candidates: DataFrame, pk: str, k: int) -> DataFrame:
    """The ``k`` nearest per query out of the tasks' candidates, in two steps.

    The first step spreads the candidates of one query over buckets, so that one query's share of a
    very large number of tasks is not sorted in one place.
    """
    nearest = [F.col(DISTANCE), F.col(pk)]
    bucket = F.pmod(F.xxhash64(pk), F.lit(64))
    local = Window.partitionBy(QUERY_ID, "bucket").orderBy(*nearest)
    whole = Window.partitionBy(QUERY_ID).orderBy(*nearest)
    few = (
        candidates.withColumn("bucket", bucket)
        .withColumn("place", F.row_number().over(local))
        .where(F.col("place") <= k)
        .drop("bucket", "place")
    )
    return few.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= k)


def _check(k: int, metric: str) -> None:
    if metric not in METRICS:
        raise InvalidRequest(f"unsupported metric '{metric}', use one of {', '.join(METRICS)}")
    if k < 0:
        raise InvalidRequest("limit must not be negative")


def nearest_keys(
    df: DataFrame,
    queries: Sequence[Sequence[float]] | DataFrame,
    vector: str,
    pk: str,
    k: int,
    metric: str = "L2",
) -> DataFrame:
    """``(query_id, <pk>, distance, place)``: exact k nearest rows of each query vector.

    ``queries`` is a list of vectors (ids are their positions), which every task gets as it is, or a table ``(query_id, <vector>)``
    of any size, which meets the rows by pivots.
    """
    _check(k, metric)
    if isinstance(queries, DataFrame):
        from .pivots import nearest_join

        return nearest_join(df, queries, vector, pk, k, metric)
    schema = _candidate_schema(df, pk)
    if k == 0:
        return df.sparkSession.createDataFrame([], schema).withColumn("place", F.lit(0))
    kernel = _top_kernel(pk, list(range(len(queries))), np.array(queries, dtype="f8"), k, metric)
    return _merge_top(df.select(pk, vector).mapInArrow(kernel, schema), pk, k)


def _with_fields(df: DataFrame, found: DataFrame, pk: str, columns: Sequence[str], rows: int) -> DataFrame:
    """Fetch output columns of found keys: the second scan skips the vectors unless they are asked for."""
    needed = [c for c in columns if c != pk]
    if not needed:
        return found
    keys = F.broadcast(found) if rows <= BROADCAST_ROWS else found
    return df.select(pk, *needed).join(keys, pk)


def vector_search(
    df: DataFrame,
    data: Sequence[Sequence[float]],
    vector: str,
    pk: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    metric: str = "L2",
    filter: str = "",
    output_fields: Sequence[str] | None = None,
    late: bool = False,
) -> DataFrame:
    """The ``limit`` nearest rows, nearest first, by the collection's metric.

    As one result is returned, only the first query vector counts. The distance is not output.
    ``late`` finds the keys of a small result with a job of its own, and then reads only their rows.
    """
    if not data:
        raise InvalidRequest("a search needs a vector")
    rows = _filtered(df, filter)
    found = nearest_keys(rows, [data[0]], vector, pk, limit, metric)
    fields = list(output_fields) if output_fields is not None else sorted(df.columns)
    if late and 0 < limit <= LATE_KEYS and set(fields) != {pk}:
        near = found.toArrow()
        found = df.sparkSession.createDataFrame(near)
        df = df.where(key_filter(pk, near.column(pk).to_pylist())) if near.num_rows else df.limit(0)
    hits = _with_fields(df, found, pk, fields, limit).orderBy(DISTANCE, pk)
    return order_fields(hits.drop(QUERY_ID, DISTANCE, "place"), fields)


def vector_search_batch(
    df: DataFrame,
    queries: Sequence[Sequence[float]] | DataFrame,
    vector: str,
    pk: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    metric: str = "L2",
    filter: str = "",
    output_fields: Sequence[str] = (),
) -> DataFrame:
    """Nearest rows of every query vector: ``query_id, place, <pk>, distance`` and output fields."""
    found = nearest_keys(_filtered(df, filter), queries, vector, pk, limit, metric)
    rows = BROADCAST_ROWS + 1 if isinstance(queries, DataFrame) else len(queries) * limit
    extra = [c for c in output_fields if c != pk]
    return _with_fields(df, found, pk, extra, rows).select(QUERY_ID, "place", pk, DISTANCE, *extra)


# -- approximate search over a stored index ----------------------------------------------------


@dataclass(frozen=True)
class CellIndex:
    """A collection stored by nearest centre; ``cells`` has the row count of each cell, ``radii`` how far its rows are at most."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    cells: dict[int, int]
    vector: str
    pk: str
    schema: T.StructType


def build_cell_index(
    df: DataFrame, vector: str, pk: str, cells: int | None = None, seed: int = 7, path: str | None = None
) -> CellIndex:
    """Cluster the vectors and store the collection by cell in the new folder ``path``, whence it can be opened again.

    Centres are learned from all rows. Their number grows with the root of the number of rows, if
    ``cells`` doesn't set it. Rows without a vector are not stored. The rows are rebalanced by cell before
    the write: adaptive execution splits a cell that holds most of the data over many tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    if CELL in df.columns:
        raise InvalidRequest(f"the column name '{CELL}' is the index's own")
    path = scratch_path(spark, "cells") if path is None else path
    points = df.where(F.col(vector).isNotNull())
    total = points.count()
    if total:
        wanted = max(2, int(total**0.5)) if cells is None else cells
        features = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        centres = np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(features).clusterCenters())
    else:
        centres = np.zeros((1, 1))

    @F.arrow_udf("int")
    def cell_of(vectors: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(vectors), QUERY_BLOCK):
            rows, _ = _as_matrix(vectors.slice(at, QUERY_BLOCK), centres.shape[1])
            found.append(_rough_distances(rows, centres, "L2")[0].argmin(axis=1))
        return pa.array(np.concatenate(found) if found else [], pa.int32())

    assigned = points.withColumn(CELL, cell_of(vector))
    stored = spark.sql(f"SELECT /*+ REBALANCE({CELL}) */ * FROM {{assigned}}", assigned=assigned)
    stored.write.partitionBy(CELL).parquet(f"{path}/{ROWS}")
    # Only cells with rows are listed; a centre that is nearest to no row is never probed.
    rows = spark.read.schema(assigned.schema).parquet(f"{path}/{ROWS}").select(vector, CELL)
    counts = rows.mapInArrow(_measured(centres), "cell int, count long, radius double").groupBy("cell")
    counts = counts.agg(F.sum("count").alias("count"), F.max("radius").alias("radius"))
    means = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    kept = means.join(counts, "cell", "left").na.fill(0, ["count", "radius"])
    about = [F.lit(x).alias(n) for n, x in (("vector", vector), ("pk", pk), ("schema", assigned.schema.json()))]
    kept.select("cell", "centre", "count", "radius", *about).write.parquet(f"{path}/{CENTRES}")
    return open_cell_index(spark, path)


def _measured(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (vector, cell) rows: how many each cell has, and the largest distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius = np.zeros(len(centres), "i8"), np.zeros(len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                some = batch.slice(at, QUERY_BLOCK)
                rows, _ = _as_matrix(some.column(0), centres.shape[1])
                cells = some.column(1).to_numpy(zero_copy_only=False)
                gap = rows - centres[cells]
                np.add.at(count, cells, 1)
                np.maximum.at(radius, cells, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(count[own]), pa.array(radius[own])], names=["cell", "count", "radius"]
        )

    return run


def open_cell_index(spark: SparkSession, path: str) -> CellIndex:
    """The index that was built into ``path``; reads its centres, which grow with the root of its rows."""
    found = spark.read.parquet(f"{path}/{CENTRES}").orderBy("cell").collect()
    schema = T.StructType.fromJson(json.loads(found[0]["schema"]))
    centres = np.array([r["centre"] for r in found])
    # An index that was stored without radii gives no bound, so that all of its cells are read.
    radii = np.array([r["radius"] if "radius" in r else np.inf for r in found])
    return CellIndex(path, centres, radii, {r["cell"]: r["count"] for r in found}, found[0]["vector"], found[0]["pk"], schema)


def vector_search_approx(
    spark: SparkSession,
    index: CellIndex,
    queries: Sequence[Sequence[float]],
    limit: int = DEFAULT_SEARCH_LIMIT,
    probe: int | None = None,
    metric: str = "L2",
    filter: str = "",
    output_fields: Sequence[str] = (),
) -> DataFrame:
    """Nearest rows by the cells of an index; cells that a query doesn't probe are not read.

    Without ``probe`` none of the nearest rows is missed: a job of its own finds how far the ``limit``-th row of
    the ``FIRST_CELLS`` nearest cells is, and all cells that can have a nearer row are read. If those cells have
    fewer rows that pass the filter, every cell is.

    With ``probe`` only so many cells nearest to the query are read, or more when they hold fewer than ``limit``
    rows. Distances are exact, but nearer rows may be in other cells, and a filter can leave fewer rows.
    """
    _check(limit, metric)
    matrix = np.array(queries, dtype="f8")
    probes = [_probed(index, q, limit, FIRST_CELLS if probe is None else probe) for q in matrix]
    if probe is None and limit:
        _, top = _probe(spark, index, matrix, limit, metric, filter, probes)
        known = top.groupBy(QUERY_ID).agg(F.count("*").alias("found"), F.max(DISTANCE).alias("last")).collect()
        safe = {r[QUERY_ID]: r["last"] for r in known if r["found"] >= limit}
        probes = [p | _within(index, q, safe.get(i, np.inf), metric) for i, (p, q) in enumerate(zip(probes, matrix))]
    rows, top = _probe(spark, index, matrix, limit, metric, filter, probes)
    extra = [c for c in output_fields if c != index.pk]
    return _with_fields(rows, top, index.pk, extra, len(matrix) * limit).select(QUERY_ID, "place", index.pk, DISTANCE, *extra)


def _probe(
    spark: SparkSession,
    index: CellIndex,
    matrix: np.ndarray,
    limit: int,
    metric: str,
    filter: str,
    probes: Sequence[frozenset[int]],
) -> tuple[DataFrame, DataFrame]:
    """The filtered rows of all probed cells, and the nearest rows of each query in its own."""
    wanted = sorted(c for c in frozenset().union(*probes) if index.cells.get(c))
    rows = _filtered(read_cells(spark, index, wanted), filter)
    kernel = _top_kernel(index.pk, list(range(len(matrix))), matrix, limit, metric, probes)
    found = rows.select(index.pk, index.vector, CELL).mapInArrow(kernel, _candidate_schema(rows, index.pk))
    return rows, _merge_top(found, index.pk, limit)


def _within(index: CellIndex, query: np.ndarray, last: float, metric: str) -> frozenset[int]:
    """The cells that can have a row at most ``last`` from the query, by their centres and radii."""
    centres, radii = index.centres, index.radii
    if query.shape != centres.shape[1:]:
        return frozenset(range(len(centres)))
    size, sizes = np.sqrt(np.dot(query, query)), np.sqrt(np.einsum("ij,ij->i", centres, centres))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        slack = 1e-9 * (1.0 + size + sizes + np.where(np.isfinite(radii), radii, 0.0)) ** 2
        if metric == "L2":
            least = np.maximum(0.0, np.sqrt(_distances(centres, query, "L2")) - radii) ** 2
        elif metric == "IP":
            least = -(centres @ query) - size * radii
        else:
            # A row is seen from the origin at most so far from its centre; one around the origin, anywhere.
            wide = np.where(radii < sizes, np.arcsin(np.minimum(1.0, radii / sizes)), np.pi)
            angle = np.arccos(np.clip(centres @ query / (sizes * size), -1.0, 1.0))
            least = 1.0 - np.cos(np.maximum(0.0, angle - wide))
        beyond = least > last + slack
    return frozenset(np.flatnonzero(~beyond).tolist())


def read_cells(spark: SparkSession, index: CellIndex, cells: Sequence[int]) -> DataFrame:
    """The stored rows of some cells; other folders are not even listed."""
    if not cells:
        return spark.createDataFrame([], index.schema)
    folders = [f"{index.path}/{ROWS}/{CELL}={c}" for c in cells]
    return spark.read.schema(index.schema).option("basePath", f"{index.path}/{ROWS}").parquet(*folders)


def _probed(index: CellIndex, query: np.ndarray, limit: int, probe: int) -> frozenset[int]:
    taken: list[int] = []
    rows = 0
    for cell in np.argsort(_distances(index.centres, query, "L2"), kind="stable"):
        if len(taken) >= probe and rows >= limit:
            break
        taken.append(int(cell))
        rows += index.cells.get(int(cell), 0)
    return frozenset(taken)
