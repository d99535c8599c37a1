"""Connections, files, SQLite files, schema discovery and the batch export."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..hub import Hub
from ..operators.search import default_index_column
from ..session import scratch_path
from ..sources import export, files, sqlite, sqltext
from .tables import location, table

FLAGSHIP = """
    SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n_orders,
           CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE c.c_acctbal > 0
    GROUP BY c.c_mktsegment, o.o_orderpriority
"""

ENDINGS = {"click": ".parquet", "view": ".CSV", "signup": ".jsonl", "purchase": ".NDJson", "error": ".json"}

CONNECTION_DDL = (
    "metadata struct<id: string, tenant_id: string, created_at: string, updated_at: string>, "
    "resource struct<name: string, data_connection_type_id: string, format: string, "
    "admin: struct<secret_ref: string>, properties: map<string, string>>"
)
TYPE_DDL = (
    "metadata struct<id: string, tenant_id: string, created_at: string, updated_at: string>, "
    "resource struct<name: string, provider: string, description: string>"
)


def demo_hub(spark: SparkSession, sf_dir: str) -> Hub:
    """A catalog with one SQL connection over the tables and one to their files."""
    stamp = "2026-01-01T00:00:00Z"

    def document(doc_id: str, tenant: str, resource: dict) -> dict:
        metadata = {"id": doc_id, "tenant_id": tenant, "created_at": stamp, "updated_at": stamp}
        return {"metadata": metadata, "resource": resource}

    def connection(name: str, kind: str, **properties: str) -> dict:
        # a map is a list of pairs in Arrow
        resource = {"name": name, "data_connection_type_id": kind, "format": "tabular", "properties": list(properties.items())}
        return document(name, "team", resource)

    def small(rows: list[dict], ddl: str) -> DataFrame:
        return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(T.StructType.fromDDL(ddl))))

    connections = [
        connection("warehouse", "type-postgres", location=location(sf_dir), tables="orders,customer"),
        connection("lake", "type-s3", location=sf_dir),
    ]
    types = [document(f"type-{p}", "global", {"name": p, "provider": p}) for p in ("postgres", "s3")]
    return Hub(spark, small(connections, CONNECTION_DDL), small(types, TYPE_DDL), "team")


def hub_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_hub(spark, sf_dir).read(FLAGSHIP, "warehouse")


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_hub(spark, sf_dir).read("lineitem.parquet", "lake")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, sf_dir, "orders")
    orders.write.option("header", "true").option("escape", '"').csv(path)
    return files.read_csv(spark, path)


def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-jsonl")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string"))
    events.withColumn("place", F.struct("user_id", "event_type")).drop("user_id").write.json(path)
    read = files.read_jsonl(spark, path)
    return read.select("event_id", "event_type", "value", "props", "ts", F.col("place.user_id").alias("user_id"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of a table of object paths; the endings are made of the event types."""
    ending = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), F.col("event_type")
    )
    paths = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("logs/"), F.col("user_id"), F.lit("/"), F.col("event_id"), ending).alias("path")
    )
    return paths.select("event_id", "path", files.format_column(F.col("path")).alias("format"))


def sqlite_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, written by each task as a SQLite file of its own, read back through SQL."""
    folder = sqlite.local_path(scratch_path(spark, "sqlite"))
    os.makedirs(folder)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # a name per attempt, moved into place at the end, so that a lost task can be run again
        path = f"{folder}/part-{part}.db"
        draft = f"{path}.{TaskContext.get().taskAttemptId()}"
        connection = sqlite3.connect(draft)
        connection.execute(
            "CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT)"
        )
        rows = 0
        for frame in frames:
            connection.executemany("INSERT INTO customer VALUES (?, ?, ?, ?, ?)", frame.astype(object).values.tolist())
            rows += len(frame)
        connection.commit()
        connection.close()
        os.replace(draft, path)
        yield pd.DataFrame({"rows": [rows]})

    customer = table(spark, sf_dir, "customer")
    customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").mapInPandas(
        write, "rows long"
    ).agg(F.sum("rows")).collect()
    text = "SELECT c_custkey, c_name, c_acctbal * 2 AS doubled, c_mktsegment FROM customer WHERE c_acctbal > 0"
    return sqlite.read_sqlite(spark, folder, text, "c_custkey", 4)


def describe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqltext.describe_query(table(spark, sf_dir, "orders"))


def resolve_default_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("requested"),
        F.create_map(F.lit("index"), F.concat(F.lit("user-"), F.col("user_id"))).alias("properties"),
    )
    index = default_index_column(F.col("requested"), F.col("properties"))
    return requests.select("event_id", index.alias("index_name"))


# Rows of an exported batch.
EXPORTED = 4096


def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    export.export_batches(table(spark, sf_dir, "events"), path, EXPORTED)
    return files.read_parquet(spark, path)


def export_batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a table is delivered in, whether a batch is too long, and whether there are as many as that takes."""
    path = scratch_path(spark, "export")
    export.export_batches(table(spark, sf_dir, "events"), path, EXPORTED)
    sizes = files.read_parquet(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        (F.max("n") <= EXPORTED).alias("bounded"),
        (F.count(F.lit(1)) >= F.ceil(F.sum("n") / EXPORTED)).alias("cut"),
    )


QUERIES = {
    "hub_read": hub_read,
    "parquet_scan": parquet_scan,
    "csv_scan": csv_scan,
    "jsonl_scan": jsonl_scan,
    "detect_format": detect_format,
    "sqlite_read": sqlite_read,
    "describe_query": describe_query,
    "resolve_default_index": resolve_default_index,
    "export_batches": export_batches,
    "export_batch_sizes": export_batch_sizes,
}
ORACLE = {
    "hub_read": FLAGSHIP,
    "parquet_scan": "SELECT * FROM lineitem",
    "csv_scan": "SELECT * FROM orders",
    "jsonl_scan": """
        SELECT event_id, event_type, value, props, regexp_replace(CAST(ts AS VARCHAR), '\\.?0+$', '') AS ts, user_id
        FROM events
    """,
    "detect_format": """
        SELECT event_id, concat('logs/', user_id, '/', event_id, CASE event_type WHEN 'click' THEN '.parquet'
                 WHEN 'view' THEN '.CSV' WHEN 'signup' THEN '.jsonl' WHEN 'purchase' THEN '.NDJson' ELSE '.json' END) AS path,
               CASE event_type WHEN 'click' THEN 'parquet' WHEN 'view' THEN 'csv'
                 WHEN 'signup' THEN 'jsonl' WHEN 'purchase' THEN 'jsonl' END AS format
        FROM events
    """,
    "sqlite_read": """
        SELECT c_custkey, c_name, c_acctbal * 2 AS doubled, c_mktsegment FROM customer WHERE c_acctbal > 0
    """,
    "describe_query": """
        SELECT CAST(ordinal_position - 1 AS INT) AS position, column_name AS name,
               CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                              WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type,
               is_nullable = 'YES' AS nullable
        FROM information_schema.columns WHERE table_name = 'orders'
    """,
    "resolve_default_index": """
        SELECT event_id, coalesce(nullif(event_type, 'view'), 'user-' || CAST(user_id AS VARCHAR)) AS index_name
        FROM events
    """,
    "export_batches": "SELECT * FROM events",
    "export_batch_sizes": "SELECT count(*) AS n_rows, true AS bounded, true AS cut FROM events",
}
