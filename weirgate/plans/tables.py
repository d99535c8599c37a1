"""Access to the tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def location(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/{{name}}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(location(sf_dir).replace("{name}", name))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a document table whose tenant is the event type; ``view`` stands for shared rows."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("tenant_id"),
            F.lit("2024-01-01T00:00:00Z").alias("created_at"),
            F.lit("2024-01-01T00:00:00Z").alias("updated_at"),
        ).alias("metadata"),
        F.struct(
            F.concat(F.lit("event-"), F.col("event_id")).alias("name"),
            F.col("user_id"),
            F.col("value"),
            F.col("props"),
        ).alias("resource"),
        F.struct(
            F.struct((F.col("value") > 25).alias("flight"), (F.col("value") > 50).alias("rest")).alias("capabilities")
        ).alias("status"),
    )
