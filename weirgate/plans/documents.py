"""Operations on document tables made of events, orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ERROR_CODES
from ..functions import redact
from ..operators import catalog, rollups
from ..session import scratch_path
from .tables import event_documents, table

GLOBAL = "view"


def _flat(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(
        F.col("metadata.id").alias("id"),
        F.col("metadata.tenant_id").alias("tenant_id"),
        F.col("resource.user_id").alias("user_id"),
        F.col("resource.value").alias("value"),
        *extra,
    )


def tenant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(catalog.tenant_list(event_documents(spark, sf_dir), "click"), "total_count")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all events of tenant ``click``, one of them per user asked for under another tenant."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    tenant = F.when(F.col("value") > 10, F.lit("error")).otherwise(F.lit("click"))
    return events.select(F.col("event_id").cast("string").alias("id"), tenant.alias("tenant_id"))


def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(catalog.tenant_lookup(event_documents(spark, sf_dir), _wanted(spark, sf_dir)))


def tenant_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tenant_missing(event_documents(spark, sf_dir), _wanted(spark, sf_dir))


def global_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(catalog.global_visibility(event_documents(spark, sf_dir), "click", GLOBAL))


def insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a document of its customer; customers with money have one already."""
    existing = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    batch = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("name"))
    return catalog.insert_unique(existing.select(F.col("c_custkey").alias("name")), batch, ["name"], "o_orderkey")


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers; a customer belongs to its market segment, MACHINERY to all."""
    targets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tenant_id")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit("BUILDING").alias("tenant"))
    return catalog.reference_check(rows, "o_custkey", "tenant", targets, "MACHINERY")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases get an amount, errors lose ``k``, clicks are replaced deeper down, others stay."""
    patch = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"amount":'), F.col("value"), F.lit("}")))
        .when(F.col("event_type") == "error", F.lit('{"k":null,"state":"failed"}'))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"k":{"was":'), F.col("user_id"), F.lit(',"gone":null}}')))
    )
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), patch.alias("patch"))
    return events.where(F.col("patch").isNotNull())


def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "props", F.lit("2024-01-01T00:00:00Z").alias("updated_at")
    )
    return catalog.merge_patch(docs, _patches(spark, sf_dir), "props", now="2026-01-01T00:00:00Z")


def merge_patch_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for flat string maps, without Python."""
    events = table(spark, sf_dir, "events")
    target = F.from_json("props", "map<string,string>")
    patch = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("amount"), F.col("value").cast("string"))).when(
        F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit(None).cast("string"), F.lit("state"), F.lit("failed"))
    )
    merged = catalog.merge_patch_map(target, patch)
    return events.select(
        "event_id",
        F.try_element_at(merged, F.lit("k")).alias("k"),
        F.try_element_at(merged, F.lit("amount")).alias("amount"),
        F.try_element_at(merged, F.lit("state")).alias("state"),
        F.size(merged).alias("n_keys"),
    )


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tenant_id")).alias("metadata"),
        F.struct("o_custkey", "o_totalprice").alias("resource"),
    )


def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after all urgent ones were deleted by tenant ``F``."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    keys = orders.select(F.col("o_orderkey").alias("id"), F.lit("F").alias("tenant_id"))
    remaining, _ = catalog.delete_keys(_order_documents(spark, sf_dir), keys)
    return remaining.select("metadata.id", "metadata.tenant_id", "resource.*")


def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urgent keys that tenant ``F`` does not have."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    keys = orders.select(F.col("o_orderkey").alias("id"), F.lit("F").alias("tenant_id"))
    _, missing = catalog.delete_keys(_order_documents(spark, sf_dir), keys)
    return missing


SUPPORTED = ("Brand#1", "Brand#4", "Brand#7", "Brand#13")


def capability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_brand",
        F.struct(
            F.struct((F.col("p_size") > 25).alias("flight"), (F.col("p_size") > 40).alias("rest")).alias("capabilities")
        ).alias("status"),
    )
    changed = catalog.capability_audit(parts, "p_brand", SUPPORTED)
    return changed.select("p_partkey", "p_brand", "status.capabilities.*")


def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders need a customer and, if open, a price; done ones have no secret at all."""
    fields = F.array(
        F.struct(F.lit("customer").alias("name"), F.lit(True).alias("required")),
        F.struct(F.lit("price").alias("name"), (F.col("o_orderstatus") == "O").alias("required")),
        F.struct(F.lit("note").alias("name"), F.lit(False).alias("required")),
    )
    secret = F.map_filter(
        F.create_map(
            F.lit("customer"), F.when(F.col("o_custkey") > 100, F.col("o_custkey").cast("string")),
            F.lit("price"), F.when(F.col("o_totalprice") > 200000, F.lit("high")),
        ),
        lambda _, v: v.isNotNull(),
    )
    reference = F.when(F.col("o_orderstatus") != "F", F.lit("ref"))
    found = catalog.required_keys(table(spark, sf_dir, "orders"), fields, secret, reference)
    return found.select("o_orderkey", "missing_key")


def _secret_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = F.col("c_acctbal") > 5000
    admin = F.struct(
        F.when(~inline, F.concat(F.lit("ref-"), F.col("c_custkey"))).alias("secret_ref"),
        F.when(inline, F.col("c_name")).alias("name"),
        F.when(inline, F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"))).alias("secret"),
    )
    return table(spark, sf_dir, "customer").select(
        F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tenant_id")).alias("metadata"),
        F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, admin).alias("admin")).alias("resource"),
    )


def split_inline_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = catalog.split_inline_secret(_secret_documents(spark, sf_dir))
    return docs.select("metadata.id", "resource.name", F.col("resource.admin.secret_ref").alias("secret_ref"))


def split_inline_secret_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, secrets = catalog.split_inline_secret(_secret_documents(spark, sf_dir))
    return secrets.select(
        "name",
        "namespace",
        F.col("properties")["balance"].alias("balance"),
        F.col("labels")[catalog.ATTACHED_LABEL].alias("attached"),
    )


def redact_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            F.col("user_id"),
            F.col("value").alias("Auth_Token"),
            F.array(F.struct(F.col("props").alias("clientSecret"), F.col("event_type").alias("kind"))).alias("list"),
        ).alias("doc"),
        F.create_map(F.lit("api_key"), F.col("props"), F.lit("kind"), F.col("event_type")).alias("map"),
        F.concat(
            F.lit('{"id":'), F.col("event_id"), F.lit(',"DB_PASSWORD":'), F.col("props"),
            F.lit(',"in":[{"private_key":null,"k":'), F.col("user_id"), F.lit("}]}"),
        ).alias("body"),
    )
    masked = redact.redact_sensitive(events)
    return masked.select(
        "event_id",
        F.to_json("doc").alias("doc"),
        F.col("map")["api_key"].alias("api_key"),
        F.col("map")["kind"].alias("kind"),
        redact.redact_json_text(F.col("body")).alias("body"),
    )


def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    login = F.regexp_replace("url", "://", F.concat(F.lit("://user"), F.col("page_id"), F.lit(":p@ss:w0rd@")))
    return table(spark, sf_dir, "pages").select(
        "page_id", redact.redact_url(F.col("url")).alias("plain"), redact.redact_url(login).alias("login")
    )


def validate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return catalog.validate_domain(events, "event_type", ("view", "click", "purchase"), "event type")


def flatten_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = event_documents(spark, sf_dir)
    # a resource field of the same name as a metadata field hides it
    docs = docs.withColumn("resource", F.col("resource").withField("updated_at", F.col("resource.name")))
    flat = catalog.flatten_envelope(docs, {"description": F.lit("none")})
    return flat.withColumn("status", F.col("status.capabilities.flight"))


def seed_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as seeds for documents of their users, of which customers have one already."""
    existing = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 2000).select(F.col("c_custkey").alias("user_id"))
    phase = F.when(F.col("event_type") == "view", F.lit(catalog.COMPLETED)).when(
        F.col("event_type") == "click", F.lit(catalog.PENDING)
    )
    seeds = table(spark, sf_dir, "events").select("event_id", "user_id", phase.alias("phase"))
    return catalog.seed_if_absent(seeds, existing, ["user_id"], "event_id")


def parse_field_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("p_size") < 5, F.lit("not json"))
        .when(F.col("p_size") < 10, F.lit('{"name":"no list"}'))
        .when(F.col("p_size") < 15, F.concat(F.lit('[{"envVar":'), F.col("p_size"), F.lit("}]")))
        .when(F.col("p_size") < 20, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.lit('[{"type":"short-text","name":"'), F.col("p_name"), F.lit('","envVar":"'), F.col("p_brand"),
                F.lit('","required":true},{"name":"'), F.col("p_type"), F.lit('"}]'),
            )
        )
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", catalog.parse_field_specs(text).alias("fields"))
    return parts.select("p_partkey", F.posexplode_outer("fields").alias("position", "field")).select(
        "p_partkey",
        "position",
        F.col("field.name").alias("name"),
        F.col("field.label").alias("label"),
        F.col("field.required").alias("required"),
        F.col("field.type").alias("type"),
    )


ROLLUP_BUCKETS = (1.0, 5.0, 10.0, 50.0, 100.0)


def rpc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls, with the value as the duration."""
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"),
        F.when(F.col("user_id") < 50, F.lit("read")).otherwise(F.lit("list")).alias("operation"),
        F.when(F.col("value") > 100, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.col("value").cast("decimal(18,2)").alias("duration"),
    )
    found = catalog.rpc_rollup(calls, "duration", buckets=ROLLUP_BUCKETS)
    numbers = ["duration_sum", "duration_min", "duration_max"]
    found = found.withColumn("duration_avg", F.round(F.col("duration_sum").cast("double") / F.col("requests_total"), 6))
    return found.withColumns({c: F.col(c).cast("double") for c in numbers})


def rollup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of events rolled up and stored, one in ten of them later than the others, and merged to days; whether each day's median is one."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("method"), F.col("value").alias("duration"))
    path, late = scratch_path(spark, "rollup"), F.col("event_id") % 10 == 3
    for calls in (events.where(~late), events.where(late)):
        rollups.window_rollup(calls, "ts", "duration", "1 hour", ["method"], buckets=ROLLUP_BUCKETS).write.mode("append").parquet(path)
    days = rollups.with_quantiles(rollups.merge_rollups(spark.read.parquet(path), "1 day", ["method"]), [0.5])
    days = days.withColumn("median", F.element_at("duration_quantiles", 1))
    # Calls below and up to the sketch's median: half of all lies between the two, but for the stated error.
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    met = events.select(day.alias(rollups.START), "method", "duration").join(days.select(rollups.START, "method", "median"), [rollups.START, "method"])
    ranks = met.groupBy(rollups.START, "method").agg(
        F.avg((F.col("duration") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("duration") <= F.col("median")).cast("int")).alias("up_to")
    )
    error = rollups.rank_error()
    half = (F.col("below") <= 0.5 + error) & (F.col("up_to") >= 0.5 - error)
    return days.join(ranks, [rollups.START, "method"]).select(
        rollups.START,
        "method",
        "requests_total",
        "duration_min",
        "duration_max",
        *[F.element_at(rollups.BUCKETS, i + 1).alias(f"le_{b:g}") for i, b in enumerate(ROLLUP_BUCKETS)],
        half.alias("median_fits"),
    )


_KINDS = [*ERROR_CODES, "SomethingElse"]


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error log with every kind of error and one that is not known."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    log = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(kinds, (F.pmod("event_id", F.lit(len(_KINDS))) + 1).cast("int")).alias("kind")
    )
    return catalog.classify_errors(log, "kind")


QUERIES = {
    "tenant_list": tenant_list,
    "tenant_lookup": tenant_lookup,
    "tenant_missing": tenant_missing,
    "global_visibility": global_visibility,
    "insert_unique": insert_unique,
    "reference_check": reference_check,
    "merge_patch": merge_patch,
    "merge_patch_flat": merge_patch_flat,
    "delete_keys": delete_keys,
    "delete_missing": delete_missing,
    "capability_audit": capability_audit,
    "required_keys": required_keys,
    "split_inline_secret": split_inline_secret,
    "split_inline_secret_store": split_inline_secret_store,
    "redact_sensitive": redact_sensitive,
    "redact_url": redact_url,
    "validate_domain": validate_domain,
    "flatten_envelope": flatten_envelope,
    "seed_if_absent": seed_if_absent,
    "parse_field_specs": parse_field_specs,
    "rpc_rollup": rpc_rollup,
    "rollup_merged": rollup_merged,
    "classify_errors": classify_errors,
}

_DOC_COLUMNS = "CAST(event_id AS VARCHAR) AS id, event_type AS tenant_id, user_id, value"


_CLASSIFIED = """
        WITH kinds(place, kind, code, http_status, grpc_status) AS (VALUES
          (0, 'InvalidRequest', 'invalid_request', 400, 'INVALID_ARGUMENT'), (1, 'NoDataError', 'no_data', 404, 'NOT_FOUND'),
          (2, 'ConfigError', 'config', 500, 'INTERNAL'), (3, 'ConnectionError', 'connection', 503, 'UNAVAILABLE'),
          (4, 'SQLError', 'sql_error', 400, 'INTERNAL'), (5, 'IOError', 'io_error', 500, 'INTERNAL'),
          (6, 'ResourceNotFound', 'not_found', 404, 'NOT_FOUND'), (7, 'Config', 'config', 500, 'INTERNAL'),
          (8, 'Connection', 'connection', 503, 'UNAVAILABLE'), (9, 'Query', 'query_error', 500, 'INTERNAL'),
          (10, 'Conflict', 'conflict', 409, 'ALREADY_EXISTS'), (11, 'Serialization', 'serialization', 400, 'INTERNAL'),
          (12, 'Deserialization', 'deserialization', 400, 'INTERNAL'), (13, 'Validation', 'validation', 400, 'INVALID_ARGUMENT'),
          (14, 'SecretNotFound', 'secret_not_found', 404, 'NOT_FOUND'), (15, 'Forbidden', 'forbidden', 403, 'PERMISSION_DENIED'),
          (16, 'CannotCreateSecret', 'cannot_create_secret', 400, 'INTERNAL'), (17, 'CannotDeleteSecret', 'cannot_delete_secret', 400, 'INTERNAL'),
          (18, 'CannotSetSecretLabels', 'cannot_set_secret_labels', 400, 'INTERNAL'), (19, 'SomethingElse', 'internal', 500, 'INTERNAL'))
        SELECT event_id, kind, code, http_status, grpc_status FROM events JOIN kinds ON event_id % 20 = place
"""


ORACLE = {
    "tenant_list": f"""
        SELECT {_DOC_COLUMNS}, (SELECT count(*) FROM events WHERE event_type = 'click') AS total_count
        FROM events WHERE event_type = 'click'
    """,
    "tenant_lookup": f"SELECT {_DOC_COLUMNS} FROM events WHERE event_type = 'click' AND value <= 10",
    "tenant_missing": """
        SELECT CAST(event_id AS VARCHAR) AS id, 'error' AS tenant_id FROM events WHERE event_type = 'click' AND value > 10
    """,
    "global_visibility": """
        SELECT CAST(event_id AS VARCHAR) AS id, nullif(event_type, 'view') AS tenant_id, user_id, value
        FROM events WHERE event_type IN ('click', 'view')
    """,
    "insert_unique": """
        WITH b AS (SELECT o_orderkey, o_custkey AS name,
                          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
        SELECT o_orderkey, name,
               CASE WHEN n = 1 AND name NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
                    THEN 'accepted' ELSE 'conflict' END AS outcome
        FROM b
    """,
    "reference_check": """
        SELECT o_orderkey, o_custkey, 'BUILDING' AS tenant,
               CASE WHEN c_custkey IS NULL THEN concat('unknown reference ''', o_custkey, '''') END AS reason
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY')
    """,
    "merge_patch": """
        SELECT event_id AS id,
               CASE event_type
                 WHEN 'purchase' THEN concat(replace(replace(props, ' ', ''), '}', ''), ',"amount":', value, '}')
                 WHEN 'error' THEN '{"state":"failed"}'
                 WHEN 'click' THEN concat('{"k":{"was":', user_id, '}}')
                 ELSE props END AS props,
               CASE WHEN event_type IN ('purchase', 'error', 'click') THEN '2026-01-01T00:00:00Z'
                    ELSE '2024-01-01T00:00:00Z' END AS updated_at
        FROM events
    """,
    "merge_patch_flat": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k,
               CASE WHEN event_type = 'purchase' THEN CAST(value AS VARCHAR) END AS amount,
               CASE WHEN event_type = 'error' THEN 'failed' END AS state,
               CAST(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS INT) AS n_keys
        FROM events
    """,
    "delete_keys": """
        SELECT o_orderkey AS id, o_orderstatus AS tenant_id, o_custkey, o_totalprice FROM orders
        WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
    """,
    "delete_missing": """
        SELECT o_orderkey AS id, 'F' AS tenant_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'
    """,
    "capability_audit": """
        SELECT p_partkey, p_brand, p_brand IN ('Brand#1', 'Brand#4', 'Brand#7', 'Brand#13') AS flight, p_size > 40 AS rest
        FROM part WHERE (p_brand IN ('Brand#1', 'Brand#4', 'Brand#7', 'Brand#13')) <> (p_size > 25)
    """,
    "required_keys": """
        SELECT o_orderkey, 'admin.secret_ref' AS missing_key FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, 'customer' FROM orders WHERE o_orderstatus <> 'F' AND o_custkey <= 100
        UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 200000
    """,
    "split_inline_secret": """
        SELECT c_custkey AS id, c_name AS name,
               CASE WHEN c_acctbal > 5000 THEN c_name WHEN c_acctbal >= 0 THEN concat('ref-', c_custkey) END AS secret_ref
        FROM customer
    """,
    "split_inline_secret_store": """
        SELECT c_name AS name, c_mktsegment AS namespace, CAST(c_acctbal AS VARCHAR) AS balance, 'true' AS attached
        FROM customer WHERE c_acctbal > 5000
    """,
    "redact_sensitive": """
        SELECT event_id,
               concat('{"user_id":', user_id, ',"Auth_Token":"***","list":[{"clientSecret":"***","kind":"', event_type, '"}]}') AS doc,
               '***' AS api_key, event_type AS kind,
               concat('{"id":', event_id, ',"DB_PASSWORD":"***","in":[{"private_key":"***","k":', user_id, '}]}') AS body
        FROM events
    """,
    "redact_url": """
        SELECT page_id, url AS plain, replace(url, '://', concat('://user', page_id, ':***@')) AS login FROM pages
    """,
    "validate_domain": """
        SELECT event_id, event_type, CASE WHEN event_type NOT IN ('view', 'click', 'purchase')
          THEN concat('unsupported event type ''', event_type, ''', expected one of: view, click, purchase') END AS reason
        FROM events
    """,
    "flatten_envelope": """
        SELECT CAST(event_id AS VARCHAR) AS id, event_type AS tenant_id, '2024-01-01T00:00:00Z' AS created_at,
               concat('event-', event_id) AS updated_at, concat('event-', event_id) AS name, user_id, value, props,
               value > 25 AS status, 'none' AS description
        FROM events
    """,
    "seed_if_absent": """
        WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
                   FROM events WHERE event_type <> 'view')
        SELECT e.event_id, e.user_id,
               CASE WHEN e.event_type = 'view' THEN 'Completed' WHEN a.event_id IS NOT NULL THEN 'Completed'
                    ELSE 'AlreadyExists' END AS phase,
               a.event_id IS NOT NULL AS added
        FROM events e LEFT JOIN (
          SELECT t.event_id FROM t JOIN events x USING (event_id)
          WHERE n = 1 AND x.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)
        ) a ON a.event_id = e.event_id
    """,
    "parse_field_specs": """
        SELECT p_partkey, CAST(0 AS INT) AS position, p_brand AS name, p_name AS label, true AS required, 'string' AS type
        FROM part WHERE p_size >= 20
        UNION ALL SELECT p_partkey, 1, '', p_type, false, 'string' FROM part WHERE p_size >= 20
        UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_size < 20
    """,
    "rpc_rollup": """
        WITH c AS (SELECT event_type AS method, CASE WHEN user_id < 50 THEN 'read' ELSE 'list' END AS operation,
                          CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS status, CAST(value AS DECIMAL(18, 2)) AS d FROM events)
        SELECT method, operation, status, count(*) AS requests_total, CAST(sum(d) AS DOUBLE) AS duration_sum,
               round(CAST(sum(d) AS DOUBLE) / count(*), 6) AS duration_avg, CAST(min(d) AS DOUBLE) AS duration_min,
               CAST(max(d) AS DOUBLE) AS duration_max, count(*) FILTER (WHERE d <= 1) AS le_1,
               count(*) FILTER (WHERE d <= 5) AS le_5, count(*) FILTER (WHERE d <= 10) AS le_10,
               count(*) FILTER (WHERE d <= 50) AS le_50, count(*) FILTER (WHERE d <= 100) AS le_100
        FROM c GROUP BY method, operation, status
    """,
    "rollup_merged": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS method, count(*) AS requests_total,
               min(value) AS duration_min, max(value) AS duration_max, count(*) FILTER (WHERE value <= 1) AS le_1,
               count(*) FILTER (WHERE value <= 5) AS le_5, count(*) FILTER (WHERE value <= 10) AS le_10,
               count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 100) AS le_100, true AS median_fits
        FROM events GROUP BY ALL
    """,
    "classify_errors": _CLASSIFIED,
}
