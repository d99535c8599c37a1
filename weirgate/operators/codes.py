"""Approximate nearest neighbours by product-quantised codes, re-ranked exactly (V6).

The index of a collection has a code of a byte per few dimensions for each row, next to the columns that filters use, and the rows
themselves, sorted by key in small pages. A search scans codes and filter columns alone: a query's distances to all centres of each
part are tables, and a row's rough distance is a sum of look-ups. The short list that is left is read by its keys, which page
indexes find, and ranked by exact distances.

Codebooks are learned from at most ``sample`` rows, those with the smallest hashes of their keys; all rows are coded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest
from ..session import scratch_path
from .ranking import key_filter
from .vector import DEFAULT_SEARCH_LIMIT, DISTANCE, QUERY_ID, _as_matrix, _candidate_schema, _check, _filtered, _merge_top, _nearest, _top_kernel

# Dimensions of a code's byte, centres of a part, rows that codebooks are learned from, steps of learning.
PART_DIMS, CENTRES, SAMPLE, STEPS = 4, 256, 65_536, 12
# Rows of a page of the stored rows, and of a group of pages.
PAGE_ROWS, CODE, NORM = 16, "__code", "__norm"
STORED = {"parquet.writer.version": "PARQUET_2_0", "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.enable.dictionary": "false"}
CODED = {"parquet.writer.version": "PARQUET_2_0"}
# Keys that are looked up as part of a filter; a longer list is joined.
FILTER_KEYS = 2000


@dataclass(frozen=True)
class CodeIndex:
    """A coded collection in a folder; ``books`` has the centres of each part."""

    path: str
    vector: str
    pk: str
    schema: T.StructType
    edges: tuple[int, ...]
    books: tuple[np.ndarray, ...]
    rows: int

    def coded(self, spark: SparkSession) -> DataFrame:
        kept = [f for f in self.schema.fields if f.name != self.vector]
        schema = T.StructType([*kept, T.StructField(CODE, T.BinaryType()), T.StructField(NORM, T.FloatType())])
        return spark.read.schema(schema).parquet(f"{self.path}/codes")

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def _learned(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The centres of one part by Lloyd's steps, from different points far apart."""
    points = np.array(table.sort_by("place").column("values").to_pylist(), "f8")
    rng = np.random.default_rng(key[0].as_py())
    unique = np.unique(points, axis=0)
    centres = unique[rng.permutation(len(unique))[:CENTRES]]
    for _ in range(STEPS):
        near = _assign(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    columns = [pa.array(np.full(len(centres), key[0].as_py(), "i4")), pa.array(np.arange(len(centres), dtype="i4")), pa.array(centres.tolist(), pa.list_(pa.float64()))]
    return pa.Table.from_arrays(columns, names=["part", "centre", "values"])


def _assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", centres, centres)
    found = [(squares[None, :] - 2.0 * points[a : a + 8192] @ centres.T).argmin(axis=1) for a in range(0, len(points), 8192)]
    return np.concatenate(found) if found else np.zeros(0, "i8")


def build_code_index(
    df: DataFrame, vector: str, pk: str, path: str | None = None, *, part_dims: int = PART_DIMS, sample: int = SAMPLE
) -> CodeIndex:
    """Writes the index of a collection into a new folder, whence it can be opened again. Rows without a vector are not stored."""
    spark = df.sparkSession
    if {CODE, NORM} & set(df.columns):
        raise InvalidRequest(f"the column names '{CODE}' and '{NORM}' are the index's own")
    path = path or scratch_path(spark, "codes")
    points = df.where(F.col(vector).isNotNull())
    total, dims = points.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    edges = [*range(0, dims or 1, part_dims), dims or 1]
    kind = F.col(vector).cast("array<double>")
    picked = points.select(F.xxhash64(pk).alias("place"), kind.alias("v")).orderBy("place").limit(sample)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.slice("v", a + 1, b - a).alias("values")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))
    cut = picked.select("place", parts.alias("p")).select("place", "p.part", "p.values")
    learned = cut.groupBy("part").applyInArrow(_learned, "part int, centre int, values array<double>").orderBy("part", "centre").collect()  # 256 centres a part
    books = tuple(np.array([r["values"] for r in learned if r["part"] == i], "f8").reshape(-1, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))

    @F.arrow_udf("binary")
    def code_of(vectors: pa.Array) -> pa.Array:
        rows, _ = _as_matrix(vectors, edges[-1])
        codes = [_assign(rows[:, a:b], book).astype("u1") for a, b, book in zip(edges, edges[1:], books, strict=False)]
        whole = np.stack(codes, axis=1).tobytes()
        return pa.array([whole[i : i + len(books)] for i in range(0, len(whole), len(books))], pa.binary())

    squares = F.aggregate(kind, F.lit(0.0), lambda s, x: s + x * x)
    coded = points.withColumns({CODE: code_of(F.col(vector)), NORM: F.sqrt(squares).cast("float")}).drop(vector)
    coded.repartitionByRange(pk).sortWithinPartitions(pk).write.options(**CODED).parquet(f"{path}/codes")
    points.repartitionByRange(pk).sortWithinPartitions(pk).write.options(**STORED).parquet(f"{path}/rows")
    about = json.dumps({"vector": vector, "pk": pk, "schema": df.schema.json(), "edges": edges, "rows": total, "books": [b.tolist() for b in books]})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return open_code_index(spark, path)


def open_code_index(spark: SparkSession, path: str) -> CodeIndex:
    """The index that was built into ``path``; reads its codebooks, whose size doesn't grow with the rows."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    edges = tuple(about["edges"])
    books = tuple(np.array(book, "f8").reshape(len(book), b - a) for a, b, book in zip(edges, edges[1:], about["books"], strict=False))
    return CodeIndex(path, about["vector"], about["pk"], T.StructType.fromJson(json.loads(about["schema"])), edges, books, about["rows"])


def _tables(index: CodeIndex, query: np.ndarray, metric: str) -> np.ndarray:
    """What each centre of each part adds to a rough distance."""
    out = np.zeros((len(index.books), CENTRES))
    for i, (a, b, book) in enumerate(zip(index.edges, index.edges[1:], index.books, strict=False)):
        gap = query[a:b] - book
        out[i, : len(book)] = np.einsum("ij,ij->i", gap, gap) if metric == "L2" else -(book @ query[a:b])
    return out


def _rough(index: CodeIndex, matrix: np.ndarray, k: int, metric: str):
    """Per task the ``k`` rows of each query with the smallest rough distances."""
    tables = [_tables(index, q, metric) for q in matrix]
    sizes = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), None)] * len(matrix)
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(batch.num_rows, -1).T.astype("i8")
            norms = batch.column(2).to_numpy(zero_copy_only=False) if metric == "COSINE" else None
            for i, table in enumerate(tables):
                found = np.zeros(batch.num_rows)
                for part, own in zip(table, codes, strict=True):
                    found += part[own]
                if norms is not None:
                    size = norms * sizes[i]
                    found = 1.0 + np.divide(found, size, out=np.zeros_like(found), where=size > 0)
                known, known_keys = best[i]
                both = np.concatenate((known, found)), keys if known_keys is None else np.concatenate((known_keys, keys))
                top = _nearest(*both, k)
                best[i] = both[0][top], both[1][top]
        for i, (found, found_keys) in enumerate(best):
            if len(found):
                columns = [pa.array(np.full(len(found), i, "i8")), pa.array(found_keys, kind), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, [QUERY_ID, index.pk, DISTANCE])

    return run


def vector_search_codes(
    spark: SparkSession,
    index: CodeIndex,
    queries: Sequence[Sequence[float]],
    limit: int = DEFAULT_SEARCH_LIMIT,
    metric: str = "L2",
    filter: str = "",
    output_fields: Sequence[str] = (),
    shortlist: int | None = None,
) -> DataFrame:
    """``query_id, place, <pk>, distance`` and output fields: the nearest rows of a short list of ten times ``limit`` rows (at least 100) by codes.

    Distances are exact; a nearer row can be missed if its code is among those of ``shortlist`` others. The short lists are found
    by a job of its own.
    """
    _check(limit, metric)
    matrix = np.array(queries, dtype="f8")
    coded = _filtered(index.coded(spark), filter)
    schema = _candidate_schema(coded, index.pk)
    extra = [c for c in output_fields if c != index.pk]
    listed = max(10 * limit, 100) if shortlist is None else max(shortlist, limit)
    columns = [index.pk, CODE, *([NORM] if metric == "COSINE" else [])]
    rough = coded.select(*columns).mapInArrow(_rough(index, matrix, listed, metric), schema)
    found = _merge_top(rough, index.pk, listed).select(index.pk).distinct()
    keys = [r[0] for r in found.collect()] if limit and len(matrix) * listed <= FILTER_KEYS else None
    stored = index.stored(spark)
    if keys is not None:
        stored = stored.where(key_filter(index.pk, keys)) if keys else stored.limit(0)
    else:
        # At most so many keys as the requests list.
        stored = stored.join(F.broadcast(found), index.pk, "left_semi")
    kernel = _top_kernel(index.pk, list(range(len(matrix))), matrix, limit, metric)
    exact = stored.select(index.pk, index.vector).mapInArrow(kernel, schema) if limit else spark.createDataFrame([], schema)
    top = _merge_top(exact, index.pk, max(1, limit))
    if extra:
        top = stored.select(index.pk, *extra).join(F.broadcast(top), index.pk)
    return top.select(QUERY_ID, "place", index.pk, DISTANCE, *extra)
