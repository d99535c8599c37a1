"""Plans on data where one key holds a third of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weirgate.operators import catalog, graph

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}
TARGETS = 20_000


@pytest.fixture
def skewed(spark):
    """Joins cannot broadcast, and partitions count as skewed at a size that fits a test."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spread = F.pmod(F.xxhash64("id"), F.lit(TARGETS))
    yield spark.range(0, 300_000, 1, 8).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(spread).alias("ref"),
        F.lit("red").alias("tenant"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    for key, value in before.items():
        spark.conf.set(key, value)


def run(df) -> tuple[int, str]:
    """Row count, and the plan as it was finally executed."""
    executed = df._jdf.queryExecution().executedPlan()
    return executed.execute().count(), executed.toString()


def test_hot_reference_is_split(spark, skewed):
    targets = spark.range(TARGETS).select("id", F.lit("red").alias("tenant_id"))
    rows, plan = run(catalog.reference_check(skewed, "ref", "tenant", targets, "global"))
    assert rows == 300_000
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_node_is_split(spark, skewed):
    nodes = spark.range(TARGETS).select("id", F.array(F.lit("N")).alias("labels"), F.struct(F.col("id").alias("k")).alias("properties"))
    edges = skewed.select(
        "id", F.pmod("id", F.lit(TARGETS)).alias("src"), F.col("ref").alias("dst"), F.lit("E").alias("typ"), F.struct("payload").alias("properties")
    )
    found = graph.match_edge(nodes, edges, "E", {"a": "a.properties.k", "b": "b.properties.k", "p": "r.properties.payload"})
    rows, plan = run(found)
    assert rows == 300_000
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_name_is_never_gathered(spark, skewed):
    """Only pre-aggregated rows are shuffled by name; the batch itself moves by its unique order."""
    existing = spark.range(0, TARGETS, 2).select(F.col("id").alias("ref"))
    marked = catalog.insert_unique(existing, skewed, ["ref"], "id")
    plan = marked._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "partial_min(id" in plan
    assert "[id#" in plan.split("LeftOuter")[0].split("SortMergeJoin")[1]
    counts = {r["outcome"]: r["count"] for r in marked.groupBy("outcome").count().collect()}
    assert counts["accepted"] == skewed.where("ref % 2 = 1").select("ref").distinct().count()
    assert sum(counts.values()) == 300_000


def test_hot_group_is_aggregated_in_the_tasks(skewed):
    plan = catalog.rpc_rollup(skewed, "id", by=["ref"])._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan
