"""Operations on tables of ``{metadata, resource, status}`` documents.

A document table has struct columns ``metadata<id, tenant_id, created_at, updated_at>``, ``resource``
and ``status``. Nothing is changed in place: an operation returns the new rows, and the caller writes
them as the table's next version. Joins are on keys that are unique on one side, so a key that holds
much of the data is hot on the other side only, where adaptive execution splits it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ERROR_CODES, UNKNOWN_ERROR

# The providers a connection type may name, in the order messages list them.
PROVIDERS = ("postgres", "sqlite", "s3", "milvus", "elasticsearch", "neo4j")
# Fixed value: label of a secret that belongs to a document.
ATTACHED_LABEL = "attached"

PHASES_TYPE = "array<struct<state: string, message: string, timestamp: string>>"
STATUS_TYPE = f"struct<state: string, message: string, phases: {PHASES_TYPE}>"

TENANT, ID = "metadata.tenant_id", "metadata.id"


def now_text() -> str:
    """The current time in whole seconds, ``2026-01-31T12:00:00Z``. Taken once per operation."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


# -- reading -----------------------------------------------------------------------------------


def tenant_list(docs: DataFrame, tenant: str) -> DataFrame:
    """All documents of a tenant, with their ``total_count`` on every row."""
    own = docs.where(F.col(TENANT) == tenant)
    total = own.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return own.withColumn("total_count", total)


def tenant_lookup(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose id and tenant are both in ``keys(id, tenant_id)``."""
    wanted = keys.select(F.col("id").alias("__id"), F.col("tenant_id").alias("__tenant"))
    same = (F.col(ID) == F.col("__id")) & (F.col(TENANT) == F.col("__tenant"))
    return docs.join(wanted, same, "left_semi")


def tenant_missing(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys without a document: wrong id, or a document of another tenant.

    The documents are first narrowed down to the keys, which needs no shuffle of the documents when
    the keys are few.
    """
    known = tenant_lookup(docs, keys).select(F.col(ID).alias("__id"), F.col(TENANT).alias("__tenant"))
    same = (F.col("id") == F.col("__id")) & (F.col("tenant_id") == F.col("__tenant"))
    return keys.join(known, same, "left_anti")


def visible_to(docs: DataFrame, tenant: str, global_tenant: str) -> Column:
    return F.col(TENANT).isin(tenant, global_tenant)


def hide_global_tenant(docs: DataFrame, global_tenant: str) -> DataFrame:
    """Documents of the global tenant show no tenant."""
    tenant = F.when(F.col(TENANT) != global_tenant, F.col(TENANT))
    return docs.withColumn("metadata", F.col("metadata").withField("tenant_id", tenant))


def global_visibility(docs: DataFrame, tenant: str, global_tenant: str) -> DataFrame:
    """What a tenant sees in a list: its own documents and the global ones."""
    return hide_global_tenant(docs.where(visible_to(docs, tenant, global_tenant)), global_tenant)


def flatten_envelope(docs: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """One flat row per document. ``resource`` wins over ``metadata`` on equal names.

    The status and any other column stay. ``defaults`` fills absent values, e.g. ``{"tenant_id": F.lit("")}``.
    """
    resource = docs.schema["resource"].dataType.fieldNames()
    metadata = [f for f in docs.schema["metadata"].dataType.fieldNames() if f not in resource]
    columns = {name: F.col(f"metadata.`{name}`") for name in metadata}
    columns |= {name: F.col(f"resource.`{name}`") for name in resource}
    columns |= {name: F.col(f"`{name}`") for name in docs.columns if name not in ("metadata", "resource")}
    for name, default in (defaults or {}).items():
        columns[name] = F.coalesce(columns[name], default) if name in columns else default
    return docs.select(*[c.alias(name) for name, c in columns.items()])


# -- writing -----------------------------------------------------------------------------------


def default_status() -> Column:
    """A new document is not ready and has no history."""
    message, phases = F.lit(None).cast("string"), F.array().cast(PHASES_TYPE)
    return F.struct(F.lit("not_ready").alias("state"), message.alias("message"), phases.alias("phases"))


def with_default_status(docs: DataFrame) -> DataFrame:
    """Documents written before there was a status read as not ready."""
    return docs.withColumn("status", F.coalesce(F.col("status"), default_status()))


def document_id(batch: str, order: Column) -> Column:
    """A new document's id in UUID form, made of its batch and its unique place there.

    The batch is drawn once, so the id stays when a lost task is run again, and never comes back.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(batch), order.cast("string")), 256)
    groups = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in groups])


def default_capabilities() -> Column:
    """A new connection type has no capability until an audit finds one."""
    none = F.struct(F.lit(False).alias("flight"), F.lit(False).alias("rest"))
    return F.struct(none.alias("capabilities"))


def new_documents(
    requests: DataFrame, tenant: str, now: str | None = None, status: Column | None = None, order: str = "seq"
) -> DataFrame:
    """Wrap ``requests(resource, seq, ...)`` into documents: metadata with a fresh id and times, default status."""
    stamp = F.lit(now or now_text())
    metadata = F.struct(
        document_id(uuid.uuid4().hex, F.col(order)).alias("id"),
        F.col(tenant).alias("tenant_id"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )
    return requests.withColumn("metadata", metadata).withColumn(
        "status", default_status() if status is None else status
    )


def insert_unique(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: str, outcome: str = "outcome"
) -> DataFrame:
    """Mark each row of a batch: ``accepted``, or ``conflict`` with an existing or an earlier key.

    The first row per key, by the unique column ``order``, is the one that can be accepted. First rows
    are a pre-aggregated minimum, and the batch is joined by ``order`` alone, so a key that fills the
    batch is never in one place. The table is narrowed down to the batch's keys before anything else.
    """
    first = batch.groupBy(*keys).agg(F.min(order).alias("__first"))
    taken = existing.select(*keys).join(first, list(keys), "left_semi")
    fresh = first.join(taken, list(keys), "left_anti").select("__first")
    marked = batch.join(fresh, F.col(order) == F.col("__first"), "left")
    accepted = F.when(F.col("__first").isNotNull(), F.lit("accepted")).otherwise(F.lit("conflict"))
    return marked.withColumn(outcome, accepted).drop("__first")


def insert_documents(
    docs: DataFrame,
    requests: DataFrame,
    tenant: str = "tenant_id",
    now: str | None = None,
    status: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(the table's next version, conflicts)`` for ``requests(resource, <tenant>, seq)``."""
    keyed = requests.withColumn("__name", F.col("resource.name")).withColumn("__tenant", F.col(tenant))
    known = docs.select(F.col("resource.name").alias("__name"), F.col(TENANT).alias("__tenant"))
    marked = insert_unique(known, keyed, ["__name", "__tenant"], "seq")
    accepted = marked.where(F.col("outcome") == "accepted")
    added = new_documents(accepted, tenant, now, status).select("metadata", "resource", "status")
    conflicts = marked.where(F.col("outcome") == "conflict").drop("__name", "__tenant")
    return docs.select("metadata", "resource", "status").unionByName(added), conflicts


def reference_check(
    rows: DataFrame,
    reference: str,
    tenant: str,
    targets: DataFrame,
    global_tenant: str,
    reason: str = "reason",
) -> DataFrame:
    """Add a ``reason`` to each row whose reference is not an id of its own or the global tenant.

    ``targets`` is ``(id, tenant_id)``. Passing rows have a NULL reason.
    """
    # ids are unique, so each list holds one tenant, and one join answers for both tenants
    known = targets.groupBy(F.col("id").alias("__target")).agg(F.collect_set("tenant_id").alias("__owners"))
    # Rows without a reference would all meet in one place, and need no target.
    found = rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("__target"), "left")
    found = found.unionByName(rows.where(F.col(reference).isNull()), allowMissingColumns=True)
    seen = F.array_contains("__owners", F.col(tenant)) | F.array_contains("__owners", F.lit(global_tenant))
    text = F.concat(F.lit("unknown reference '"), F.col(reference).cast("string"), F.lit("'"))
    missing = F.when(~F.coalesce(seen, F.lit(False)), F.coalesce(text, F.lit("no reference")))
    return found.withColumn(reason, missing).drop("__target", "__owners")


def merge_patch_map(target: Column, patch: Column) -> Column:
    """Merge patch for flat string maps: a null value deletes its key, any other replaces it."""
    kept = F.map_filter(target, lambda k, _: ~F.map_contains_key(patch, k))
    given = F.map_filter(patch, lambda _, v: v.isNotNull())
    merged = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), given)
    return F.when(patch.isNull(), target).otherwise(merged)


def _merged(target: object, patch: object) -> object:
    if not isinstance(patch, dict):
        return patch
    result = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            result.pop(key, None)
        else:
            result[key] = _merged(result.get(key), value)
    return result


@F.pandas_udf(T.StringType())
def merge_patch_json(target: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patch (RFC 7396) on JSON text at any depth; Arrow-batched. No patch, no change."""

    def apply(old: str | None, change: str | None) -> str | None:
        if change is None:
            return old
        new = _merged(json.loads(old) if old else None, json.loads(change))
        return json.dumps(new, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([apply(t, p) for t, p in zip(target, patch)], dtype=object)


def merge_patch(
    docs: DataFrame, patches: DataFrame, doc: str, now: str | None = None, key: str = "id", patch: str = "patch"
) -> DataFrame:
    """Apply ``patches(id, patch)``, at most one per id, to the JSON text column ``doc``.

    Only patched rows get a new time.
    """
    given = patches.where(F.col(patch).isNotNull()).select(key, F.col(patch).alias("__patch"))
    # only patched rows go to Python
    touched = docs.join(given, key).withColumn(doc, merge_patch_json(F.col(doc), F.col("__patch")))
    if "updated_at" in docs.columns:
        touched = touched.withColumn("updated_at", F.lit(now or now_text()))
    others = docs.join(given.select(key), key, "left_anti")
    return others.select(*docs.columns).unionByName(touched.select(*docs.columns))


def delete_keys(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(remaining documents, keys that matched nothing)`` for ``keys(id, tenant_id)``."""
    wanted = keys.select(F.col("id").alias("__id"), F.col("tenant_id").alias("__tenant"))
    same = (F.col(ID) == F.col("__id")) & (F.col(TENANT) == F.col("__tenant"))
    return docs.join(wanted, same, "left_anti"), tenant_missing(docs, keys)


def capability_audit(docs: DataFrame, provider: str, supported: Iterable[str]) -> DataFrame:
    """Documents whose ``status.capabilities.flight`` changes, with its new value; ``rest`` is kept.

    ``supported`` is the list of connectors, which is code and not data, so it is part of the filter.
    """
    able = F.coalesce(F.col(provider).isin(list(supported)), F.lit(False))
    current = F.coalesce(F.col("status.capabilities.flight"), F.lit(False))
    changed = docs.where(able != current)
    return changed.withColumn("status", F.col("status").withField("capabilities.flight", able))


# -- validation --------------------------------------------------------------------------------


def required_keys(docs: DataFrame, fields: Column, secret: Column, secret_ref: Column) -> DataFrame:
    """One row per missing required field: ``missing_key`` is its name, or ``admin.secret_ref``.

    ``fields`` is an array of structs with ``name`` and ``required``, ``secret`` the map of the
    referenced secret.
    """
    needed = F.transform(F.filter(fields, lambda f: f.getField("required")), lambda f: f.getField("name"))
    have = F.coalesce(F.map_keys(secret), F.array().cast("array<string>"))
    absent = F.filter(needed, lambda name: ~F.array_contains(have, name))
    reasons = F.when(secret_ref.isNull(), F.array(F.lit("admin.secret_ref"))).otherwise(absent)
    return docs.withColumn("missing_key", F.explode(reasons))


def split_inline_secret(docs: DataFrame, tenant: str = TENANT) -> tuple[DataFrame, DataFrame]:
    """``(documents with secret references only, secrets)``.

    ``resource.admin`` is a struct ``<secret_ref, name, secret map>``; an inline secret has ``name``
    and ``secret``.
    """
    admin = F.col("resource.admin")
    inline = F.col("resource.admin.secret").isNotNull()
    reference = F.struct(
        F.when(inline, F.col("resource.admin.name")).otherwise(F.col("resource.admin.secret_ref")).alias("secret_ref")
    )
    bare = F.col("resource").withField("admin", F.when(admin.isNotNull(), reference))
    secrets = docs.where(inline).select(
        F.col("resource.admin.name").alias("name"),
        F.col(tenant).alias("namespace"),
        F.col("resource.admin.secret").alias("properties"),
        F.create_map(F.lit(ATTACHED_LABEL), F.lit("true")).alias("labels"),
    )
    return docs.withColumn("resource", bare), secrets


def has_inline_secret(docs: DataFrame) -> Column:
    """True for documents that must not be stored."""
    fields = docs.select("resource.admin.*").columns
    return F.col("resource.admin.secret").isNotNull() if "secret" in fields else F.lit(False)


def validate_domain(
    rows: DataFrame, column: str, domain: Sequence[str] = PROVIDERS, what: str = "provider"
) -> DataFrame:
    """Add a ``reason`` to each row whose value is not in a fixed set; others have a NULL reason."""
    text = F.concat(
        F.lit(f"unsupported {what} '"),
        F.coalesce(F.col(column), F.lit("")),
        F.lit(f"', expected one of: {', '.join(domain)}"),
    )
    known = F.coalesce(F.col(column).isin(list(domain)), F.lit(False))
    return rows.withColumn("reason", F.when(~known, text))


def split_reasons(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """``(good rows, rejected rows with their reason)`` of a check."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


# -- seeding -----------------------------------------------------------------------------------

# The states of a seed; the first two are final.
COMPLETED, ALREADY_EXISTS, PENDING = "Completed", "AlreadyExists", "Pending"
FINAL_PHASES = (COMPLETED, ALREADY_EXISTS)


def seed_if_absent(
    seeds: DataFrame, existing: DataFrame, keys: Sequence[str], order: str, recreate: bool = False
) -> DataFrame:
    """The seeds with their new ``phase``; ``added`` marks the rows to append to the table.

    Seeds in a final phase are not tried again, so a second run adds nothing. With ``recreate`` they
    are, and a document that was lost since is made again.
    """
    final = F.coalesce(F.col("phase").isin(*FINAL_PHASES), F.lit(False))
    todo = seeds if recreate else seeds.where(~final)
    marked = insert_unique(existing, todo, keys, order, "__outcome")
    added = F.col("__outcome") == "accepted"
    phase = F.when(added, F.lit(COMPLETED)).when(final, F.col("phase")).otherwise(F.lit(ALREADY_EXISTS))
    tried = marked.withColumn("phase", phase).withColumn("added", added).drop("__outcome")
    if recreate:
        return tried
    return tried.unionByName(seeds.where(final).withColumn("added", F.lit(False)))


FIELD_SPECS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("required", T.BooleanType()),
            T.StructField("type", T.StringType()),
        ]
    )
)


def parse_field_specs(text: Column) -> Column:
    """A JSON list of ``{type, name, envVar, required}`` as field structs; NULL if it is not one.

    The field's name is the source's ``envVar``, its label the source's ``name``, its type ``string``.
    """
    items = F.try_parse_json(text).try_cast("array<variant>")

    def kind(item: Column, key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant")), F.lit("VOID"))

    def well_formed(item: Column) -> Column:
        is_object = F.schema_of_variant(item).startswith("OBJECT") | F.is_variant_null(item)
        texts = [kind(item, key).isin("STRING", "VOID") for key in ("type", "name", "envVar")]
        return reduce(lambda a, b: a & b, texts, is_object) & kind(item, "required").isin("BOOLEAN", "VOID")

    def field_of(item: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(item, "$.envVar", "string"), F.lit("")).alias("name"),
            F.coalesce(F.try_variant_get(item, "$.name", "string"), F.lit("")).alias("label"),
            F.coalesce(F.try_variant_get(item, "$.required", "boolean"), F.lit(False)).alias("required"),
            F.lit("string").alias("type"),
        )

    parsed = F.when(F.forall(items, well_formed), F.transform(items, field_of))
    return F.when(text == "null", F.array().cast(FIELD_SPECS)).otherwise(parsed)


# -- call and error logs -----------------------------------------------------------------------

# Upper bounds of the duration buckets, in the unit of the duration column.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def rpc_rollup(
    calls: DataFrame,
    duration: str,
    by: Sequence[str] = ("method", "operation", "status"),
    buckets: Sequence[float] = DURATION_BUCKETS,
    quantiles: Sequence[float] = (),
) -> DataFrame:
    """Calls, total, mean, extremes and a cumulative histogram of durations per group.

    Everything is pre-aggregated in the tasks, and the state per group does not grow with its rows;
    ``quantiles`` come from a sketch.
    """
    value = F.col(duration)
    measures = [
        F.count(F.lit(1)).alias("requests_total"),
        F.sum(value).alias("duration_sum"),
        F.avg(value).alias("duration_avg"),
        F.min(value).alias("duration_min"),
        F.max(value).alias("duration_max"),
    ]
    measures += [F.count(F.when(value <= b, 1)).alias(f"le_{b:g}".replace(".", "_")) for b in buckets]
    if quantiles:
        measures.append(F.percentile_approx(value, list(quantiles), 10_000).alias("duration_quantiles"))
    return calls.groupBy(*by).agg(*measures)


def classify_errors(log: DataFrame, kind: str) -> DataFrame:
    """Add ``code``, ``http_status`` and ``grpc_status``; unknown kinds are internal errors."""

    def looked_up(position: int) -> Column:
        entries = [F.lit(x) for name, found in ERROR_CODES.items() for x in (name, found[position])]
        return F.coalesce(F.try_element_at(F.create_map(*entries), F.col(kind)), F.lit(UNKNOWN_ERROR[position]))

    return log.withColumns({"code": looked_up(0), "http_status": looked_up(1), "grpc_status": looked_up(2)})
