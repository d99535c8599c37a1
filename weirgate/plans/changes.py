"""Batches of catalog changes on connections made of customers, nations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog, lifecycle, patching
from ..session import scratch_path
from ..streaming.seeding import watch_seeds
from .tables import location, table

STAMP, NOW = "2024-01-01T00:00:00Z", "2026-01-01T00:00:00Z"


def _metadata(doc_id, tenant):
    return F.struct(
        doc_id.alias("id"), tenant.alias("tenant_id"), F.lit(STAMP).alias("created_at"), F.lit(STAMP).alias("updated_at")
    ).alias("metadata")


def connection_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as types: those of the first three regions are shared, the others belong to BUILDING."""
    tenant = F.when(F.col("n_regionkey") < 3, F.lit("global")).otherwise(F.lit("BUILDING"))
    return table(spark, sf_dir, "nation").select(_metadata(F.col("n_name"), tenant))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection for each customer that is not in debt."""
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") >= 0)
        .select(
            _metadata(F.col("c_custkey").cast("string"), F.col("c_mktsegment")),
            F.struct(
                F.col("c_name").alias("name"),
                F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("data_connection_type_id"),
                F.lit("tabular").alias("format"),
                F.struct(F.concat(F.lit("ref-"), F.col("c_custkey")).alias("secret_ref")).alias("admin"),
                F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string")).alias("properties"),
            ).alias("resource"),
            catalog.default_status().alias("status"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a connection of its customer, with an inline secret."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    admin = F.struct(
        F.lit(None).cast("string").alias("secret_ref"),
        F.concat(F.lit("secret-"), F.col("o_orderkey")).alias("name"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("secret"),
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.struct(
            F.col("c_name").alias("name"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("data_connection_type_id"),
            F.lit("tabular").alias("format"),
            admin.alias("admin"),
            F.create_map(F.lit("order"), F.col("o_orderkey").cast("string")).alias("properties"),
        ).alias("resource"),
        F.col("c_mktsegment").alias("tenant_id"),
        F.col("o_orderkey").alias("seq"),
    )


def _created(spark: SparkSession, sf_dir: str) -> lifecycle.Change:
    docs, types = connections(spark, sf_dir), connection_types(spark, sf_dir)
    return lifecycle.create_connections(docs, types, requests(spark, sf_dir), "global", now=NOW)


def create_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir).table.select(
        F.col("resource.name").alias("name"),
        F.col("metadata.tenant_id").alias("tenant_id"),
        F.col("metadata.created_at").alias("created_at"),
        F.col("resource.admin.secret_ref").alias("secret_ref"),
        F.col("status.state").alias("state"),
    )


def create_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir).rejected.select("seq", "tenant_id", "kind", "reason")


def create_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir).secrets.select("name", "namespace", F.col("properties")["status"].alias("status"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per customer, by its balance; some are for another tenant or ask for too much."""
    text = (
        F.when(F.col("c_acctbal") < 1000, F.lit('{"properties":{"balance":null,"tier":"low"}}'))
        .when(F.col("c_acctbal") < 2000, F.lit('{"data_connection_type_id":"NATION_99"}'))
        .when(F.col("c_acctbal") < 3000, F.lit('{"admin":{"secret_ref":null,"name":"n","secret":{"k":"v"}}}'))
        .when(F.col("c_acctbal") < 4000, F.lit('{"name":null}'))
        .when(F.col("c_acctbal") < 5000, F.lit('{"admin":null,"format":"binary"}'))
    )
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("tenant_id"), text.alias("patch"))
        .where(F.col("patch").isNotNull())
    )


def _patched(spark: SparkSession, sf_dir: str) -> lifecycle.Change:
    # every nation is a shared type here, so that only the patch decides
    types = table(spark, sf_dir, "nation").select(_metadata(F.col("n_name"), F.lit("global")))
    return lifecycle.patch_connections(connections(spark, sf_dir), types, patches(spark, sf_dir), "global", now=NOW)


def patch_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = F.col("resource.properties")
    return _patched(spark, sf_dir).table.select(
        "metadata.id",
        "metadata.updated_at",
        "resource.name",
        "resource.format",
        F.col("resource.admin.secret_ref").alias("secret_ref"),
        F.try_element_at(properties, F.lit("balance")).alias("balance"),
        F.try_element_at(properties, F.lit("tier")).alias("tier"),
    )


def patch_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patched(spark, sf_dir).rejected.select("id", "tenant_id", "kind")


def _refused(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    types = table(spark, sf_dir, "nation").select(_metadata(F.concat(F.lit("NATION_"), "n_nationkey"), F.lit("global")))
    change = lifecycle.patch_connections(connections(spark, sf_dir), types, asked, "global", now=NOW)
    return change.rejected.select("id", "tenant_id", "kind", "reason")


def patch_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order patches the connection of its customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    asked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("tenant_id"), F.lit('{"format":"binary"}').alias("patch")
    )
    return _refused(spark, sf_dir, asked)


def patch_rename_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer wants a name made of its nation and its balance in hundreds, which some share."""
    hundreds = F.floor(F.col("c_acctbal") / 100).cast("string")
    name = F.concat(F.lit('{"name":"NATION_'), F.col("c_nationkey"), F.lit("/"), hundreds, F.lit('"}'))
    asked = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("tenant_id"), name.alias("patch")
    )
    return _refused(spark, sf_dir, asked)


def ordered_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order patches the connection of its customer, by its priority; some of a tenant's ask for the same name."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('{"properties":{"last":"'), key, F.lit('","place":"first"}}')))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit('{"properties":{"balance":null,"last":"'), key, F.lit('"}}')))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit('{"format":"binary","properties":{"balance":"'), key, F.lit('"}}')))
        .when(key % 3 == 0, F.lit('{"name":null,"format":"binary"}'))
        .when(key % 3 == 1, F.concat(F.lit('{"name":"shared","admin":{"secret_ref":"x'), key, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"format":"tabular","admin":{"secret_ref":"ref-'), key, F.lit('"}}')))
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("tenant_id"), key.alias("seq"), text.alias("patch")
    )


def _in_order(spark: SparkSession, sf_dir: str) -> lifecycle.Change:
    types = table(spark, sf_dir, "nation").select(_metadata(F.concat(F.lit("NATION_"), "n_nationkey"), F.lit("global")))
    return patching.patch_in_order(connections(spark, sf_dir), types, ordered_patches(spark, sf_dir), "global", now=NOW)


def patch_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = F.col("resource.properties")
    return _in_order(spark, sf_dir).table.select(
        "metadata.id",
        "metadata.updated_at",
        "resource.name",
        "resource.format",
        F.col("resource.admin.secret_ref").alias("secret_ref"),
        *(F.try_element_at(properties, F.lit(k)).alias(k) for k in ("balance", "last", "place")),
    )


def patch_in_order_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir).rejected.select("id", "tenant_id", "seq", "kind", "reason")


def supplier_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as connection types of their nations' tenants."""
    capabilities = F.struct(F.struct(F.lit(True).alias("flight"), F.lit(False).alias("rest")).alias("capabilities"))
    resource = F.struct(
        F.col("s_name").alias("name"),
        F.lit("postgres").alias("provider"),
        F.lit(None).cast("string").alias("description"),
        F.array(F.struct(F.lit("host").alias("name"), F.lit(True).alias("required"))).alias("credentials_fields"),
    )
    tenant = F.concat(F.lit("NATION_"), F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select(
        _metadata(F.col("s_suppkey").cast("string"), tenant), resource.alias("resource"), capabilities.alias("status")
    )


def _types_in_order(spark: SparkSession, sf_dir: str) -> lifecycle.Change:
    """Every order line patches the type of its supplier, by its number; lines that a supplier has twice have no place of their own."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    number, place = F.col("l_linenumber"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    text = (
        F.when(number == 1, F.concat(F.lit('{"description":"'), place, F.lit('"}')))
        .when(number == 2, F.lit('{"provider":"bogus","description":"never"}'))
        .when(number == 3, F.lit('{"provider":"s3"}'))
        .when(number == 4, F.lit('{"credentials_fields":null}'))
        .when(number == 5, F.lit('{"credentials_fields":[{"name":"url","required":false},{"name":"key","required":true}]}'))
        .when(number == 6, F.lit('{"description":null,"provider":"milvus"}'))
        .otherwise(F.lit('{"provider":7}'))
    )
    asked = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("tenant_id"),
        place.alias("seq"),
        text.alias("patch"),
    )
    return patching.patch_types(supplier_types(spark, sf_dir), asked, now=NOW)


def patch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types_in_order(spark, sf_dir).table.select(
        "metadata.id",
        "metadata.updated_at",
        "resource.name",
        "resource.provider",
        "resource.description",
        F.size("resource.credentials_fields").alias("n_fields"),
        F.col("status.capabilities.flight").alias("flight"),
    )


def patch_types_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types_in_order(spark, sf_dir).rejected.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def seed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as seeds for a document per user, which arrive in five files and are decided file by file, starting with an empty table."""
    events, drops = table(spark, sf_dir, "events"), scratch_path(spark, "seed-drops")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    fifth = F.floor((F.col("event_id") - F.lit(low)) * 5 / (F.lit(high) - F.lit(low) + 1))
    for part in range(5):
        events.where(fifth == part).coalesce(1).write.mode("append").parquet(drops)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(drops)
    phase = F.when(F.col("event_type") == "view", F.lit(catalog.COMPLETED))
    seeds = arriving.select("event_id", "user_id", phase.alias("phase"))
    outcome = scratch_path(spark, "seed-outcome")
    query = watch_seeds(
        seeds, scratch_path(spark, "seed-table"), outcome, scratch_path(spark, "seed-progress"),
        ["user_id"], "event_id", available_now=True,
    )
    query.awaitTermination()
    return spark.read.parquet(outcome).select("event_id", "user_id", "phase", "added")


QUERIES = {
    "create_connections": create_connections,
    "create_rejected": create_rejected,
    "create_secrets": create_secrets,
    "patch_connections": patch_connections,
    "patch_rejected": patch_rejected,
    "patch_twice": patch_twice,
    "patch_rename_rejected": patch_rename_rejected,
    "patch_in_order": patch_in_order,
    "patch_in_order_rejected": patch_in_order_rejected,
    "patch_types": patch_types,
    "patch_types_rejected": patch_types_rejected,
    "seed_stream": seed_stream,
}

# What each order asks for: its place, and whether it is accepted. The first order of a tenant that asks for the shared name takes it for its customer.
_ORDERED = """
    WITH asked AS (
      SELECT c_custkey, c_mktsegment AS tenant_id, o_orderkey AS seq, c_acctbal,
             CASE WHEN o_orderpriority < '4' THEN left(o_orderpriority, 1) ELSE concat('x', o_orderkey % 3) END AS what
      FROM orders JOIN customer ON o_custkey = c_custkey
    ), owner AS (SELECT tenant_id, arg_min(c_custkey, seq) AS owner FROM asked WHERE what = 'x1' AND c_acctbal >= 0 GROUP BY tenant_id),
    judged AS (
      SELECT a.*, CASE WHEN c_acctbal < 0 THEN 'ResourceNotFound' WHEN what = 'x0' THEN 'Deserialization'
                       WHEN what = 'x1' AND owner <> c_custkey THEN 'Conflict' END AS kind
      FROM asked a LEFT JOIN owner o USING (tenant_id)
    )
"""

_TYPED = """
    WITH asked AS (
      SELECT s_suppkey, l_orderkey * 8 + l_linenumber AS seq, l_linenumber AS what,
             count(*) OVER (PARTITION BY s_suppkey, l_orderkey * 8 + l_linenumber) AS times
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    ), judged AS (
      SELECT *, CASE WHEN times > 1 THEN 'the request has no seq of its own'
                     WHEN what = 2 THEN 'unsupported provider ''bogus'', expected one of: postgres, sqlite, s3, milvus, elasticsearch, neo4j'
                     WHEN what IN (4, 7) THEN 'the patched document cannot be read' END AS reason
      FROM asked
    )
"""

_JUDGED = """
    WITH r AS (
      SELECT o_orderkey AS seq, c_name AS name, c_mktsegment AS tenant_id, o_orderstatus, c_nationkey, c_acctbal >= 0 AS taken,
             coalesce(n_regionkey < 3 OR c_mktsegment = 'BUILDING', false) AS known
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    ), j AS (
      SELECT *, row_number() OVER (PARTITION BY name, tenant_id, known ORDER BY seq) AS n FROM r
    )
"""

ORACLE = {
    "create_connections": f"""
        {_JUDGED}
        SELECT c_name AS name, c_mktsegment AS tenant_id, '{STAMP}' AS created_at,
               concat('ref-', c_custkey) AS secret_ref, 'not_ready' AS state
        FROM customer WHERE c_acctbal >= 0
        UNION ALL
        SELECT name, tenant_id, '{NOW}', concat('secret-', seq), 'not_ready' FROM j WHERE known AND NOT taken AND n = 1
    """,
    "create_rejected": f"""
        {_JUDGED}
        SELECT seq, tenant_id, CASE WHEN known THEN 'Conflict' ELSE 'ResourceNotFound' END AS kind,
               CASE WHEN known THEN 'the name is taken'
                    ELSE concat('unknown reference ''NATION_', c_nationkey, '''') END AS reason
        FROM j WHERE NOT (known AND NOT taken AND n = 1)
    """,
    "create_secrets": f"""
        {_JUDGED}
        SELECT concat('secret-', seq) AS name, tenant_id AS namespace, o_orderstatus AS status
        FROM j WHERE known AND NOT taken AND n = 1
    """,
    "patch_connections": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
               CASE WHEN c_acctbal < 1000 OR c_acctbal >= 4000 AND c_acctbal < 5000 THEN '{NOW}' ELSE '{STAMP}' END AS updated_at,
               CASE WHEN c_acctbal >= 4000 AND c_acctbal < 5000 THEN 'binary' ELSE 'tabular' END AS format,
               CASE WHEN NOT (c_acctbal >= 4000 AND c_acctbal < 5000) THEN concat('ref-', c_custkey) END AS secret_ref,
               CASE WHEN c_acctbal >= 1000 THEN CAST(c_acctbal AS VARCHAR) END AS balance,
               CASE WHEN c_acctbal < 1000 THEN 'low' END AS tier
        FROM customer WHERE c_acctbal >= 0
    """,
    "patch_rejected": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS tenant_id,
               CASE WHEN c_acctbal < 0 THEN 'ResourceNotFound' WHEN c_acctbal < 2000 THEN 'ResourceNotFound'
                    WHEN c_acctbal < 3000 THEN 'Validation' ELSE 'Deserialization' END AS kind
        FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 1000 AND c_acctbal < 4000
    """,
    "patch_twice": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS tenant_id,
               CASE WHEN c_acctbal < 0 THEN 'ResourceNotFound' ELSE 'Conflict' END AS kind,
               CASE WHEN c_acctbal < 0 THEN concat('no connection ''', c_custkey, '''')
                    ELSE 'the document has several patches, which have no order' END AS reason
        FROM orders JOIN customer ON o_custkey = c_custkey
        QUALIFY c_acctbal < 0 OR count(*) OVER (PARTITION BY c_custkey) > 1
    """,
    "patch_rename_rejected": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS tenant_id,
               CASE WHEN c_acctbal < 0 THEN 'ResourceNotFound' ELSE 'Conflict' END AS kind,
               CASE WHEN c_acctbal < 0 THEN concat('no connection ''', c_custkey, '''') ELSE 'the name is taken' END AS reason
        FROM customer
        QUALIFY c_acctbal < 0 OR count(*) OVER (PARTITION BY c_mktsegment, c_nationkey, floor(c_acctbal / 100)) > 1
    """,
    "patch_in_order": f"""
        {_ORDERED}, last AS (
          SELECT c_custkey, count(*) AS n, max(seq) FILTER (what IN ('1', '2')) AS last, bool_or(what = '1') AS place, bool_or(what = 'x1') AS shared,
                 arg_max(what, seq) FILTER (what IN ('2', '3')) AS balance, max(seq) FILTER (what = '3') AS medium,
                 arg_max(what, seq) FILTER (what IN ('3', 'x2')) AS format,
                 arg_max(concat(CASE WHEN what = 'x1' THEN 'x' ELSE 'ref-' END, seq), seq) FILTER (what IN ('x1', 'x2')) AS secret
          FROM judged WHERE kind IS NULL GROUP BY c_custkey
        )
        SELECT CAST(c.c_custkey AS VARCHAR) AS id, CASE WHEN n IS NULL THEN '{STAMP}' ELSE '{NOW}' END AS updated_at,
               CASE WHEN shared THEN 'shared' ELSE c_name END AS name, CASE WHEN format = '3' THEN 'binary' ELSE 'tabular' END AS format,
               coalesce(secret, concat('ref-', c.c_custkey)) AS secret_ref,
               CASE WHEN balance = '2' THEN NULL WHEN balance = '3' THEN CAST(medium AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS balance,
               CAST(last AS VARCHAR) AS last, CASE WHEN place THEN 'first' END AS place
        FROM customer c LEFT JOIN last l USING (c_custkey) WHERE c_acctbal >= 0
    """,
    "patch_in_order_rejected": f"""
        {_ORDERED}
        SELECT CAST(c_custkey AS VARCHAR) AS id, tenant_id, seq, kind,
               CASE kind WHEN 'ResourceNotFound' THEN concat('no document ''', c_custkey, '''')
                         WHEN 'Conflict' THEN 'the name is taken' ELSE 'the patched document cannot be read' END AS reason
        FROM judged WHERE kind IS NOT NULL
    """,
    "patch_types": f"""
        {_TYPED}, last AS (
          SELECT s_suppkey, count(*) AS n, arg_max(what, seq) FILTER (what IN (3, 6)) AS provider, bool_or(what = 5) AS two,
                 arg_max(CASE WHEN what = 1 THEN CAST(seq AS VARCHAR) ELSE '' END, seq) FILTER (what IN (1, 6)) AS description
          FROM judged WHERE reason IS NULL GROUP BY s_suppkey
        )
        SELECT CAST(s.s_suppkey AS VARCHAR) AS id, CASE WHEN n IS NULL THEN '{STAMP}' ELSE '{NOW}' END AS updated_at, s_name AS name,
               CASE provider WHEN 3 THEN 's3' WHEN 6 THEN 'milvus' ELSE 'postgres' END AS provider, nullif(description, '') AS description,
               CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS n_fields, true AS flight
        FROM supplier s LEFT JOIN last l USING (s_suppkey)
    """,
    "patch_types_rejected": f"""
        {_TYPED}
        SELECT CASE WHEN times > 1 OR what = 2 THEN 'Validation' ELSE 'Deserialization' END AS kind, reason, count(*) AS n
        FROM judged WHERE reason IS NOT NULL GROUP BY ALL
    """,
    "seed_stream": """
        WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
                   FROM events WHERE event_type <> 'view')
        SELECT e.event_id, e.user_id, CASE WHEN e.event_type = 'view' OR t.n = 1 THEN 'Completed' ELSE 'AlreadyExists' END AS phase,
               coalesce(t.n = 1, false) AS added
        FROM events e LEFT JOIN t ON t.event_id = e.event_id
    """,
}
