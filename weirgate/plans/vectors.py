"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codes, vector
from .tables import table

PK, VECTOR = "vec_id", "embedding"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _first_vector(df: DataFrame) -> list[float]:
    return [float(x) for x in df.select(F.min_by(VECTOR, PK)).first()[0]]


def first_per_label(df: DataFrame) -> DataFrame:
    """One query vector per label: the one with the lowest key."""
    return df.groupBy("label").agg(F.min_by(VECTOR, PK).alias(VECTOR)).select(
        F.col("label").cast("bigint").alias(vector.QUERY_ID), VECTOR
    )


def vector_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = '{"collectionName": "embeddings", "filter": "label in [1, 2] && vec_id >= 0", "outputFields": ["vec_id", "label"]}'
    return vector.vector_dispatch(_embeddings(spark, sf_dir), request, PK)


def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.vector_query(_embeddings(spark, sf_dir), PK, "label != 3", ["label", "vec_id"], offset=5, limit=40)


def vector_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose keys a second table lists: the first and the last key of each label."""
    df = _embeddings(spark, sf_dir)
    ends = df.groupBy("label").agg(F.min(PK).alias("low"), F.max(PK).alias("high"))
    keys = ends.select(F.explode(F.array("low", "high")).alias(PK)).distinct()
    return vector.vector_get(df, keys, PK, [PK, "label"])


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    return vector.vector_search(df, [_first_vector(df)], VECTOR, PK, 10, "L2", "label > 0", [PK, "label"], late=True)


def _batch(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _embeddings(spark, sf_dir)
        found = vector.vector_search_batch(df, first_per_label(df), VECTOR, PK, 10, metric, output_fields=["label"])
        return found.withColumn(vector.DISTANCE, F.round(vector.DISTANCE, 6))

    return run


_built: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str) -> vector.CellIndex:
    """The index of a table: built once per application, opened again by its path after that."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        _built[key] = vector.build_cell_index(_embeddings(spark, sf_dir), VECTOR, PK).path
    return vector.open_cell_index(spark, _built[key])


def vector_search_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir)
    return vector.vector_search_approx(spark, _index(spark, sf_dir), [_first_vector(df)], 10)


def vector_search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a filter and all cells probed, the index gives what the exact search gives."""
    df, index = _embeddings(spark, sf_dir), _index(spark, sf_dir)
    found = vector.vector_search_approx(
        spark, index, [_first_vector(df)], 10, len(index.cells), filter="label > 0", output_fields=["label"]
    )
    return found.withColumn(vector.DISTANCE, F.round(vector.DISTANCE, 6))


def vector_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search as requests make it gives nine tenths of the nearest rows, over a query per label."""
    df, index = _embeddings(spark, sf_dir), _index(spark, sf_dir)
    exact = vector.vector_search_batch(df, first_per_label(df), VECTOR, PK, 10).select(vector.QUERY_ID, PK)
    queries = first_per_label(df).orderBy(vector.QUERY_ID).collect()
    labels = spark.createDataFrame([(i, r[0]) for i, r in enumerate(queries)], "place_of long, label long")
    found = vector.vector_search_approx(spark, index, [r[1] for r in queries], 10)
    found = found.join(labels, F.col(vector.QUERY_ID) == F.col("place_of")).select(F.col("label").alias(vector.QUERY_ID), PK)
    return _recalled(exact, found)


def _recalled(exact: DataFrame, found: DataFrame) -> DataFrame:
    """How many rows were wanted, and whether nine tenths of them were found."""
    hits = exact.join(found.withColumn("hit", F.lit(1)), [vector.QUERY_ID, PK], "left")
    return hits.agg(F.count("*").alias("wanted"), (F.coalesce(F.sum("hit"), F.lit(0)) >= F.count("*") * 0.9).alias("recalled"))


_coded: dict[tuple[str, str], str] = {}


def vector_codes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through quantised codes and a short list, which read a fraction of the vectors."""
    df, key = _embeddings(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _coded:
        _coded[key] = codes.build_code_index(df, VECTOR, PK).path
    index = codes.open_code_index(spark, _coded[key])
    exact = vector.vector_search_batch(df, first_per_label(df), VECTOR, PK, 10).select(vector.QUERY_ID, PK)
    queries = first_per_label(df).orderBy(vector.QUERY_ID).collect()
    labels = spark.createDataFrame([(i, r[0]) for i, r in enumerate(queries)], "place_of long, label long")
    found = codes.vector_search_codes(spark, index, [r[1] for r in queries], 10, shortlist=30)
    found = found.join(labels, F.col(vector.QUERY_ID) == F.col("place_of")).select(F.col("label").alias(vector.QUERY_ID), PK)
    return _recalled(exact, found)


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _embeddings(spark, sf_dir).withColumn("dims", F.size(VECTOR))
    return vector.order_fields(df, ["dims", PK], extras=["label"])


QUERIES = {
    "vector_dispatch": vector_dispatch,
    "vector_query": vector_query,
    "vector_get": vector_get,
    "vector_search": vector_search,
    "vector_search_batch": _batch("L2"),
    "vector_search_cosine": _batch("COSINE"),
    "vector_search_ip": _batch("IP"),
    "vector_search_approx": vector_search_approx,
    "vector_search_cells": vector_search_cells,
    "vector_search_recall": vector_search_recall,
    "vector_codes_recall": vector_codes_recall,
    "order_fields": order_fields,
}


def _batch_sql(distance: str) -> str:
    return f"""
        WITH q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label),
        d AS (SELECT q.query_id, e.vec_id, e.label, {distance} AS distance FROM embeddings e, q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS place FROM d)
        SELECT query_id, place, vec_id, round(distance, 6) AS distance, label FROM r WHERE place <= 10
    """


_V = "e.embedding::DOUBLE[]"

ORACLE = {
    "vector_dispatch": "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) AND vec_id >= 0",
    "vector_query": "SELECT label, vec_id FROM embeddings WHERE label <> 3 ORDER BY vec_id LIMIT 40 OFFSET 5",
    "vector_get": """
        SELECT vec_id, label FROM embeddings WHERE vec_id IN (
          SELECT min(vec_id) FROM embeddings GROUP BY label UNION SELECT max(vec_id) FROM embeddings GROUP BY label)
    """,
    "vector_search": """
        SELECT vec_id, label FROM embeddings WHERE label > 0
        ORDER BY list_distance(embedding::DOUBLE[], (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings)), vec_id
        LIMIT 10
    """,
    "vector_search_batch": _batch_sql(f"pow(list_distance({_V}, q.qv), 2)"),
    "vector_search_cosine": _batch_sql(f"1 - list_cosine_similarity({_V}, q.qv)"),
    "vector_search_ip": _batch_sql(f"-list_dot_product({_V}, q.qv)"),
    "vector_search_cells": """
        WITH d AS (SELECT vec_id, label, pow(list_distance(embedding::DOUBLE[],
                     (SELECT arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings)), 2) AS distance FROM embeddings WHERE label > 0),
        r AS (SELECT *, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INT) AS place FROM d)
        SELECT CAST(0 AS BIGINT) AS query_id, place, vec_id, round(distance, 6) AS distance, label FROM r WHERE place <= 10
    """,
    "vector_search_recall": """
        SELECT CAST(sum(least(10, n)) AS BIGINT) AS wanted, true AS recalled
        FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY label)
    """,
    "vector_codes_recall": """
        SELECT CAST(sum(least(10, n)) AS BIGINT) AS wanted, true AS recalled
        FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY label)
    """,
    "order_fields": "SELECT CAST(len(embedding) AS INT) AS dims, vec_id, label FROM embeddings",
}
