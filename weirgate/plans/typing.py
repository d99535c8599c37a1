"""Type maps, epoch conversions and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types
from .tables import table


def map_pg_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {
        "l_orderkey": "INT8",
        "l_linenumber": "INT2",
        "l_quantity": "NUMERIC",
        "l_discount": "FLOAT4",
        "l_extendedprice": "FLOAT8",
        "l_returnflag": "BPCHAR",
        "l_shipdate": "TIMESTAMP",
    }
    return types.apply_type_map(table(spark, sf_dir, "lineitem"), "postgres", declared)


def map_sqlite_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"c_custkey": "INTEGER", "c_name": "TEXT", "c_nationkey": "BOOLEAN", "c_acctbal": "REAL"}
    return types.apply_type_map(table(spark, sf_dir, "customer"), "sqlite", declared)


def map_es_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"event_id": "long", "event_type": "keyword", "value": "half_float", "ts": "date", "props": "flattened"}
    mapped = types.apply_type_map(table(spark, sf_dir, "events"), "elasticsearch", declared)
    return mapped.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def map_vector_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"vec_id": "Int64", "label": "Int8"}
    return types.apply_type_map(table(spark, sf_dir, "embeddings"), "milvus", declared)


def map_graph_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {
        "o_orderkey": "Integer",
        "o_totalprice": "Float",
        "o_orderstatus": "String",
        "o_custkey": "Map",
        "o_orderdate": "LocalDateTime",
    }
    return types.apply_type_map(table(spark, sf_dir, "orders"), "neo4j", declared)


def epoch_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shifted = F.col("ts") - F.expr("INTERVAL '60' YEAR")
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    return events.select(
        "event_id",
        types.epoch_micros(F.col("ts")).alias("micros"),
        types.epoch_micros(shifted).alias("micros_before_1970"),
        types.epoch_micros_utc(F.concat(F.col("ts").cast("string"), F.lit("+08:00")).cast("timestamp")).alias("micros_utc"),
        types.epoch_days(F.col("ts")).alias("days"),
        types.epoch_days(shifted).alias("days_before_1970"),
        types.midnight_micros(clock).alias("micros_of_day"),
    )


def stringify_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.nullif(F.col("l_extendedprice").cast("decimal(18,4)"), F.col("l_quantity").cast("decimal(18,4)")).alias("price"),
        F.struct(
            F.col("l_orderkey").alias("k"), F.nullif("l_returnflag", F.lit("A")).alias("flag")
        ).alias("doc"),
    )
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        types.stringify(F.col("price"), kinds["price"]).alias("price"),
        types.stringify(F.col("doc"), kinds["doc"]).alias("doc"),
    )


QUERIES = {
    "map_pg_types": map_pg_types,
    "map_sqlite_types": map_sqlite_types,
    "map_es_types": map_es_types,
    "map_vector_types": map_vector_types,
    "map_graph_types": map_graph_types,
    "epoch_convert": epoch_convert,
    "stringify_scalars": stringify_scalars,
}
ORACLE = {
    "map_pg_types": """
        SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(l_quantity AS VARCHAR) AS l_quantity,
               CAST(l_discount AS FLOAT) AS l_discount, l_extendedprice, l_returnflag, l_shipdate
        FROM lineitem
    """,
    "map_sqlite_types": """
        SELECT c_custkey, c_name, c_nationkey <> 0 AS c_nationkey, c_acctbal FROM customer
    """,
    "map_es_types": """
        SELECT event_id, event_type, CAST(value AS FLOAT) AS value, date_trunc('millisecond', ts) AS ts, props FROM events
    """,
    "map_vector_types": "SELECT vec_id, CAST(label AS TINYINT) AS label FROM embeddings",
    "map_graph_types": """
        SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderdate FROM orders
    """,
    "epoch_convert": """
        SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts - INTERVAL 60 YEAR) AS micros_before_1970,
               epoch_us(ts) - 28800000000 AS micros_utc,
               CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS days,
               CAST(date_diff('day', DATE '1970-01-01', CAST(ts - INTERVAL 60 YEAR AS DATE)) AS INT) AS days_before_1970,
               epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS micros_of_day
        FROM events
    """,
    "stringify_scalars": """
        SELECT l_orderkey, l_partkey, l_linenumber,
               CAST(nullif(CAST(l_extendedprice AS DECIMAL(18, 4)), CAST(l_quantity AS DECIMAL(18, 4))) AS VARCHAR) AS price,
               concat('{"k":', l_orderkey, ',"flag":',
                      CASE WHEN l_returnflag = 'A' THEN 'null' ELSE concat('"', l_returnflag, '"') END, '}') AS doc
        FROM lineitem
    """,
}
