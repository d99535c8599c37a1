"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex of ``edges`` (a, b) is connected to, as ``label``.

    Each step is a minimum per vertex, added up before its shuffle, and a join that adaptive execution
    can split. Steps are written to the scratch folder; their number grows with the logarithm of the
    vertices. Vertices without an edge are not in the result.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # Large star: every larger neighbour hangs on the smallest one.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: so do the vertex itself and its smaller neighbours.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            joined.select("a", F.col("least").alias("b"))
        )
        edges = written(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct()
    return written(edges.select(F.col("a").alias("vertex"), F.col("b").alias("label")).unionByName(roots).distinct(), "labels")
