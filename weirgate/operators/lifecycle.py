"""Batches of catalog changes, made of the document-table operators.

A change returns the table's next version and the rows that were turned down, each with its error
``kind`` and a ``reason``. The caller writes the new version to a new place and reads from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import catalog

TYPE_ID = "data_connection_type_id"
# The data formats of a connection.
FORMATS = ("tabular", "binary")

PLAIN_SECRET = "the patch holds an inline secret; store it and refer to it"
TAKEN = "the name is taken"
NO_PLACE = "the request has no seq of its own"
SEVERAL = "the document has several patches, which have no order"


@dataclass(frozen=True)
class Change:
    """The next version of a table, the rejected rows, and the secrets to store."""

    table: DataFrame
    rejected: DataFrame
    secrets: DataFrame | None = None


def _type_ids(types: DataFrame) -> DataFrame:
    return types.select(F.col(catalog.ID).alias("id"), F.col(catalog.TENANT).alias("tenant_id"))


def _slim(requests: DataFrame, field: str) -> DataFrame:
    """What a request is judged by: its order, tenant and name, and the field that is checked."""
    name, checked = F.col("resource.name").alias("__name"), F.col(f"resource.{field}").alias("__field")
    return requests.select("seq", "tenant_id", name, checked)


def _placed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(the requests whose seq is theirs alone, the others as rejected rows)``."""
    given = requests.where(F.col("seq").isNotNull())
    several = given.groupBy("seq").agg(F.count(F.lit(1)).alias("__times")).where("__times > 1").select("seq")
    others = requests.where(F.col("seq").isNull()).unionByName(given.join(several, "seq", "left_semi"))
    rejected = others.withColumn("kind", F.lit("Validation")).withColumn("reason", F.lit(NO_PLACE))
    return given.join(several, "seq", "left_anti"), rejected


def _judged(docs: DataFrame, requests: DataFrame, field: str, check: Callable[[DataFrame], DataFrame], failure: str) -> DataFrame:
    """The requests with the ``kind`` and ``reason`` of their rejection, NULL for those that can be added.

    ``check`` adds the reason of a failed check to the slim form. Only requests that passed compete for a
    name. The verdicts are written once to the scratch folder, and the requests are joined last, by ``seq``.
    """
    placed, unplaced = _placed(requests)
    checked = check(_slim(placed, field))
    known = docs.select(F.col("resource.name").alias("__name"), F.col(catalog.TENANT).alias("tenant_id"))
    passed = checked.where(F.col("reason").isNull()).drop("reason")
    marked = catalog.insert_unique(known, passed, ["__name", "tenant_id"], "seq", "__outcome")
    taken = F.col("__outcome") == "conflict"
    verdicts = marked.select("seq", F.when(taken, F.lit("Conflict")).alias("kind"), F.when(taken, F.lit(TAKEN)).alias("reason"))
    failed = checked.where(F.col("reason").isNotNull()).select("seq", F.lit(failure).alias("kind"), "reason")
    path = scratch_path(docs.sparkSession, "verdicts")
    verdicts.unionByName(failed).write.parquet(path)
    return placed.join(docs.sparkSession.read.parquet(path), "seq").unionByName(unplaced)


def _grown(docs: DataFrame, added: DataFrame, now: str | None, status: Column | None = None) -> DataFrame:
    new = catalog.new_documents(added, "tenant_id", now, status).select("metadata", "resource", "status")
    return docs.select("metadata", "resource", "status").unionByName(new)


def create_connections(
    docs: DataFrame, types: DataFrame, requests: DataFrame, global_tenant: str, now: str | None = None
) -> Change:
    """Add ``requests(resource, tenant_id, seq)``: split off secrets, check the type, refuse taken names.

    The secrets are those of accepted requests, so that a rejected one leaves nothing behind.
    """

    def check(slim: DataFrame) -> DataFrame:
        return catalog.reference_check(slim, "__field", "tenant_id", _type_ids(types), global_tenant)

    judged = _judged(docs, requests, TYPE_ID, check, "ResourceNotFound")
    added, secrets = catalog.split_inline_secret(judged.where(F.col("kind").isNull()), "tenant_id")
    rejected, _ = catalog.split_inline_secret(judged.where(F.col("kind").isNotNull()), "tenant_id")
    return Change(_grown(_with_reference_only(docs), added, now), rejected, secrets)


def _with_reference_only(docs: DataFrame) -> DataFrame:
    """A stored document's ``admin`` is a reference."""
    reference = F.struct(F.col("resource.admin.secret_ref").alias("secret_ref"))
    admin = F.when(F.col("resource.admin").isNotNull(), reference)
    return docs.withColumn("resource", F.col("resource").withField("admin", admin))


def create_types(docs: DataFrame, requests: DataFrame, now: str | None = None) -> Change:
    """Add ``requests(resource, tenant_id, seq)`` to the connection types: known providers, free names."""
    judged = _judged(docs, requests, "provider", lambda slim: catalog.validate_domain(slim, "__field"), "Validation")
    added = judged.where(F.col("kind").isNull())
    table = _grown(docs, added, now, catalog.default_capabilities())
    return Change(table, judged.where(F.col("kind").isNotNull()))


def _patched_resource(kind: T.StructType) -> Column:
    return F.from_json(catalog.merge_patch_json(F.to_json("resource"), F.col("__patch")), _with_inline_admin(kind))


def _with_inline_admin(kind: T.StructType) -> T.StructType:
    """The resource type as a request may write it, with an inline secret."""
    admin = T.StructType.fromDDL("secret_ref string, name string, secret map<string, string>")
    return T.StructType([T.StructField(f.name, admin if f.name == "admin" else f.dataType) for f in kind.fields])


def patch_connections(
    docs: DataFrame, types: DataFrame, patches: DataFrame, global_tenant: str, now: str | None = None
) -> Change:
    """Apply ``patches(id, tenant_id, patch)`` as JSON merge patches.

    A patched row is checked like a new one; a rejected patch leaves its document as it is. Id,
    creation time and status never change. Patches have no order: several for one document are all
    rejected, and so is a new name that another document has, or that two patches ask for.
    """
    docs = _with_reference_only(docs)
    asked = patches.groupBy("id", "tenant_id").agg(F.count(F.lit(1)).alias("__times"), F.first("patch").alias("__patch"))
    given = asked.select(F.col("id").alias("__id"), F.col("tenant_id").alias("__tenant"), "__times", "__patch")
    same = (F.col(catalog.ID) == F.col("__id")) & (F.col(catalog.TENANT) == F.col("__tenant"))
    # only patched documents go to Python and are checked
    joined = docs.join(given, same).withColumn("__new", _patched_resource(docs.schema["resource"].dataType))
    joined = joined.withColumn("__type", F.col(f"__new.{TYPE_ID}")).withColumn("__owner", F.col(catalog.TENANT))
    checked = catalog.reference_check(joined, "__type", "__owner", _type_ids(types), global_tenant, "__missing")

    complete = F.col("__new.name").isNotNull() & F.col("__type").isNotNull() & F.col("__new.properties").isNotNull()
    readable = F.coalesce(complete & F.col("__new.format").isin(*FORMATS), F.lit(False))
    plain = F.col("__new.admin.secret").isNotNull()
    kind = (
        F.when(F.col("__times") > 1, F.lit("Conflict"))
        .when(~readable, F.lit("Deserialization"))
        .when(plain, F.lit("Validation"))
        .when(F.col("__missing").isNotNull(), F.lit("ResourceNotFound"))
    )
    reason = (
        F.when(F.col("__times") > 1, F.lit(SEVERAL))
        .when(~readable, F.lit("the patched connection cannot be read"))
        .when(plain, F.lit(PLAIN_SECRET))
        .otherwise(F.col("__missing"))
    )
    judged = checked.withColumn("kind", kind).withColumn("reason", reason)
    renamed = judged.where(F.col("kind").isNull() & ~F.col("__new.name").eqNullSafe(F.col("resource.name")))
    wanted = renamed.groupBy(F.col("__new.name").alias("__wanted"), F.col("__owner").alias("__wanted_by")).agg(F.count(F.lit(1)).alias("__n"))
    names = docs.select(F.col("resource.name").alias("__wanted"), F.col(catalog.TENANT).alias("__wanted_by"))
    used = wanted.join(names, ["__wanted", "__wanted_by"], "left_semi").unionByName(wanted.where("__n > 1")).select("__wanted", "__wanted_by")
    clash = (F.col("__new.name") == F.col("__wanted")) & (F.col("__owner") == F.col("__wanted_by"))
    refused_names = renamed.join(used.distinct(), clash, "left_semi").select(F.col("__id").alias("__taken"), F.col("__tenant").alias("__taken_by"))
    judged = judged.join(refused_names, (F.col("__id") == F.col("__taken")) & (F.col("__tenant") == F.col("__taken_by")), "left")
    taken = F.col("__taken").isNotNull()
    judged = judged.withColumn("kind", F.when(taken, F.lit("Conflict")).otherwise(F.col("kind")))
    judged = judged.withColumn("reason", F.when(taken, F.lit(TAKEN)).otherwise(F.col("reason")))
    accepted = F.col("kind").isNull()
    reference = F.when(
        F.col("__new.admin").isNotNull(), F.struct(F.col("__new.admin.secret_ref").alias("secret_ref"))
    )
    resource = F.when(accepted, F.col("__new").withField("admin", reference)).otherwise(F.col("resource"))
    stamp = F.when(accepted, F.lit(now or catalog.now_text())).otherwise(F.col("metadata.updated_at"))
    touched = judged.select(
        F.col("metadata").withField("updated_at", stamp).alias("metadata"), resource.alias("resource"), "status"
    )
    others = docs.join(given.select("__id", "__tenant"), same, "left_anti").select("metadata", "resource", "status")
    table = others.unionByName(touched)
    failed = judged.where(F.col("kind").isNotNull()).select("__id", "__tenant", "kind", "reason")
    of_document = (F.col("id") == F.col("__id")) & (F.col("tenant_id") == F.col("__tenant"))
    refused = patches.join(failed, of_document).select("id", "tenant_id", "patch", "kind", "reason")
    lost = catalog.tenant_missing(docs, patches).select(
        "id",
        "tenant_id",
        "patch",
        F.lit("ResourceNotFound").alias("kind"),
        F.concat(F.lit("no connection '"), F.col("id"), F.lit("'")).alias("reason"),
    )
    return Change(table, refused.unionByName(lost))


def delete_documents(docs: DataFrame, keys: DataFrame) -> Change:
    """Remove ``keys(id, tenant_id)``; keys without a document are rejected."""
    remaining, missing = catalog.delete_keys(docs, keys)
    reason = F.concat(F.lit("'"), F.col("id").cast("string"), F.lit("' not found"))
    return Change(remaining, missing.withColumn("kind", F.lit("ResourceNotFound")).withColumn("reason", reason))


def audit_types(types: DataFrame, supported: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``(the types with their present capabilities, the ones that changed)``."""
    supported = list(supported)
    able = F.coalesce(F.col("resource.provider").isin(supported), F.lit(False))
    table = types.withColumn("status", F.col("status").withField("capabilities.flight", able))
    return table, catalog.capability_audit(types, "resource.provider", supported)
