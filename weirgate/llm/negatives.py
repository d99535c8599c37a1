"""Hard negatives by exact integer scores, multiplied in residues.

Vectors become integers (floor of 256 times each component). Their inner products must be exact, while the
fast matrix product is the one of 32-bit floats; so the matrices are multiplied modulo several small primes, whose
balanced residues keep every sum below 2^24, and the signed scores are put together by Chinese remaindering in
balanced mixed radix. How many primes that takes follows from the longest vector (Cauchy-Schwarz).

1. Rows are sorted by length, label and a hash into shards of bounded size, once.
2. Each anchor goes to the shards that have rows of its label; a task holds one shard and streams anchors past it, keeps
   the best rows of each, and a window merges them into the anchor's positives.
3. Each anchor goes to all shards with the scores of its positives; a task selects, per positive, the best rows of other labels
   whose score lies in the window below the positive's.

Shards are sent once per pass and anchors once per shard, so no group has to fit in memory but a shard.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part. Only vectors of equal length
meet. Rows with equal ids are different rows. Ties go to the smaller id. Scores of 2^56 and above raise an error, because
their hundredfold wouldn't fit. An empty table, and anchors without a positive, give no rows. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cores, partitions_for, rows_out, with_rows, written

# Bytes of a shard as 32-bit floats: a task holds them once per prime.
SHARD_BYTES = 16 << 20
# Scores that a task computes at once.
CELLS = 1 << 20
SCALE = 256.0
MOST = 1 << 56
NONE = np.iinfo(np.int64).min

BEST = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
BEST_DDL = "anchor long, place int, id long, score long"


def small_primes(bound: int) -> list[int]:
    """Odd primes below 256, largest first, until their product tells all whole numbers from -bound to bound apart."""
    found, product = [], 1
    for p in range(255, 2, -2):
        if all(p % q for q in range(3, 16, 2) if q < p):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise OverflowError(f"scores up to {bound} are out of reach")


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    x = x % p
    return x - p * (x > p // 2)


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [_balanced(vectors, p).astype(np.float32) for p in primes]


def products(one: list[np.ndarray], two: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact inner products of all rows of ``one`` with all rows of ``two``, both given as residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        # So many terms stay below 2^24, where 32-bit floats are exact.
        step = (1 << 24) // (p // 2) ** 2 - 1
        rest = np.zeros((len(one[k]), len(two[k])), np.int32)
        for a in range(0, one[k].shape[1], step):
            rest += (one[k][:, a : a + step] @ two[k][:, a : a + step].T).astype(np.int32) % p
        # The digit of this prime, given those before it.
        for q, digit in zip(primes, digits, strict=False):
            rest = (rest - digit) % p * pow(q, -1, p)
        digits.append(_balanced(rest, p))
    total = np.zeros(digits[0].shape, np.int64)
    for p, digit in zip(primes[::-1], digits[::-1], strict=True):
        total = total * p + digit
    return total


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest entries of each row that aren't ``NONE``, ties by smaller id, best first."""
    n = scores.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), NONE)
    row, column = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


class Shard:
    """Rows of one length, sorted by label, as residues."""

    def __init__(self, table: pa.Table, dim: int, primes: list[int]) -> None:
        table = table.combine_chunks().sort_by("label")
        self.ids, self.rows, self.labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
        vectors = table.column("vector").combine_chunks()
        self.parts = residues(_matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, dim), primes)
        self.dim, self.primes = dim, primes

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scores(self, vectors: np.ndarray, own: slice) -> np.ndarray:
        return products(residues(vectors, self.primes), [x[own] for x in self.parts], self.primes)


def _positives(k: int):
    """The best rows of the anchors' own label."""

    def look(shard: Shard, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, labels = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        vectors = _matrix(anchors.column("vector"), shard.dim)
        for label in np.unique(labels):
            own, asked = shard.of_label(label), np.flatnonzero(labels == label)
            step = max(1, CELLS // max(1, own.stop - own.start))
            for a in range(0, len(asked), step):
                some = asked[a : a + step]
                scores = shard.scores(vectors[some], own)
                scores[rows[some][:, None] == shard.rows[own][None, :]] = NONE
                at, column = best_of(scores, shard.ids[own], k)
                yield rows_out(BEST, [rows[some][at], np.zeros(len(at), np.int32), shard.ids[own][column], scores[at, column]])

    return look


def _negatives(k: int, low: int, high: int):
    """The best rows of other labels in the window of each positive."""

    def look(shard: Shard, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, labels = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        tops = anchors.column("tops").to_pylist()
        vectors = _matrix(anchors.column("vector"), shard.dim)
        step = max(1, CELLS // max(1, len(shard.ids)))
        for a in range(0, len(rows), step):
            scores = shard.scores(vectors[a : a + step], slice(None))
            for i, label in enumerate(labels[a : a + step]):
                scores[i, shard.of_label(label)] = NONE
            most = max(map(len, tops[a : a + step]))
            for place in range(most):
                has = [i for i, own in enumerate(tops[a : a + step]) if len(own) > place]
                top = np.array([tops[a + i][place] for i in has], np.int64)[:, None]
                # 100 * score in [low * top, high * top], on whole numbers: from the ceiling to the floor of the bounds.
                some = scores[has]
                some[(some < -(-low * top // 100)) | (some > high * top // 100)] = NONE
                at, column = best_of(some, shard.ids, k)
                places = np.full(len(at), place, np.int32)
                yield rows_out(BEST, [rows[a : a + step][has][at], places, shard.ids[column], some[at, column]])

    return look


def _past_shards(look, primes: list[int]):
    """Rows come shard by shard and length by length, those of the shard first, then anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "dim", "kind")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))).tolist() if len(key) else []
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                own, kind = tuple(key[a, :2].tolist()), key[a, 2]
                if own != at:
                    at, held, shard = own, [], None
                if kind == 0:
                    held.append(batch.slice(a, b - a))
                elif held or shard:
                    if shard is None:
                        shard, held = Shard(pa.Table.from_batches(held), own[1], primes), []
                    yield from look(shard, batch.slice(a, b - a))

    return run


def _met(rows: DataFrame, asked: DataFrame, parts: int, run) -> DataFrame:
    """The shards with the anchors that were sent to them, in order."""
    columns = ["shard", "dim", "kind", "id", "row", "label", "vector", "tops"]
    none = F.lit(None).cast("array<long>").alias("tops")
    both = rows.select("shard", "dim", F.lit(0).alias("kind"), "id", "row", "label", "vector", none)
    both = both.unionByName(asked.select("shard", "dim", F.lit(1).alias("kind"), "id", "row", "label", "vector", "tops"))
    keys = ["shard", "dim", "kind"]
    return both.select(*columns).repartitionByRange(parts, "shard").sortWithinPartitions(*keys).mapInArrow(run, BEST_DDL)


def _merged(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame,
    label: Column,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels that score
    from ``low`` to ``high`` percent of it: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    vector = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()
    fit &= ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    whole = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x))
    some = df.where(fit).select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
        F.size(vector).alias("dim"),
        whole.alias("vector"),
        F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(SCALE) * x).cast("double"), F.lit(2.0))).alias("square"),
    )
    numbered = written(with_rows(some, "row"), "mining-numbered")
    n, wide, square = numbered.agg(F.count(F.lit(1)), F.max("dim"), F.max("square")).first()
    bound = int((square or 0.0) * (1 + 1e-9)) + 1
    if bound >= MOST:
        raise OverflowError(f"inner products reach {bound}; {MOST} is too much")
    primes = small_primes(bound)
    parts = partitions_for(n * max(1, wide or 1) * 4, shard_bytes, cores(df))
    dealt = numbered.repartitionByRange(parts, F.col("dim"), F.col("label"), F.xxhash64("row"))
    rows = written(dealt.withColumn("shard", F.spark_partition_id()), "mining-shards")

    asked = rows.where("asked").drop("shard").withColumn("tops", F.lit(None).cast("array<long>"))
    homes = rows.groupBy("dim", "label").agg(F.collect_set("shard").alias("shards"))
    near = asked.join(homes, ["dim", "label"]).withColumn("shard", F.explode("shards"))
    found = _merged(_met(rows, near, parts, _past_shards(_positives(positives), primes)), positives)
    pairs = written(found.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mining-positives")

    tops = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("tops"))
    tops = tops.select(F.col("anchor").alias("row"), F.col("tops.positive_score").alias("tops"))
    # A list of shards for each length: at most a number per shard and length.
    every = rows.groupBy("dim").agg(F.collect_set("shard").alias("shards"))
    all_shards = asked.drop("tops").join(tops, "row").join(F.broadcast(every), "dim").withColumn("shard", F.explode("shards"))
    worst = _merged(_met(rows, all_shards, parts, _past_shards(_negatives(negatives, low, high), primes)), negatives)

    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return worst.join(pairs, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
