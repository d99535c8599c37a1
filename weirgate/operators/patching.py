"""JSON merge patches in turn: any number of ordered patches per document.

Merge patches are functions on documents, and functions compose: two patches in a row are one step, though not always one
patch (a patch that sets a field to a text and one that adds to it as an object replace what was there). So steps have
three forms: merge (a step per key), set (a value) and drop. Composition is associative, so patches are folded
in two stages: sorted by document and order into range partitions, each partition folds its run of a document, and then
the runs of a document, one per partition, are folded. A document that has a third of all patches spreads over many partitions.

Whether a patch is accepted doesn't depend on the patches before it as long as the document is valid, because only
the fields it gives can fail. Two checks look further: the document's type may be made valid by an earlier patch, and names are
claimed. A patch that is turned down leaves the document as it is, and later ones are applied to that.

Each patch is tried once, in Python, and what the verdicts need of it is written down; they are joins of that table with small ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import catalog
from .lifecycle import FORMATS, NO_PLACE, PLAIN_SECRET, TAKEN, TYPE_ID, Change, _type_ids, _with_inline_admin, _with_reference_only

# Patches of a range partition.
PART_PATCHES = 1_000_000

# Stands for what a patch leaves as it is.
KEPT = "\0"
UNREADABLE = "the patched document cannot be read"
STEPS_DDL = "id string, tenant_id string, part int, step string"

Step = dict[str, Any]


def step_of(patch: Any) -> Step:
    """A parsed patch as a step."""
    if isinstance(patch, dict):
        return {"merge": {k: step_of(v) for k, v in patch.items()}}
    return {"drop": True} if patch is None else {"set": patch}


def compose(first: Step, then: Step, owned: bool = False) -> Step:
    """One step for two in a row. ``owned``: the first may be changed in place, so a run of steps costs what it adds."""
    if "merge" not in then:
        return then
    if "merge" not in first:
        return {"set": applied(first.get("set"), then, owned)}
    merged = first["merge"] if owned else dict(first["merge"])
    for key, step in then["merge"].items():
        merged[key] = compose(merged[key], step, owned) if key in merged else step
    return {"merge": merged}


def applied(value: Any, step: Step, owned: bool = False) -> Any:
    """A parsed document after a step; a dropped one is None. ``owned``: the document may be changed in place."""
    if "merge" not in step:
        return step.get("set")
    result = (value if owned else dict(value)) if isinstance(value, dict) else {}
    for key, own in step["merge"].items():
        if "drop" in own:
            result.pop(key, None)
        else:
            result[key] = applied(result.get(key), own, owned)
    return result


# Made once: json.dumps makes an encoder for each text.
_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def _dumped(value: Any) -> str:
    return _ENCODER.encode(value)


def conforms(value: Any, kind: T.DataType) -> bool:
    """Whether a parsed value is what a column of this type is read from; what is absent is judged later."""
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(value.get(f.name) is None or conforms(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return isinstance(value, dict) and all(conforms(v, kind.valueType) for v in value.values())
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(conforms(v, kind.elementType) for v in value)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, str)


def _tried(patch: Column, template: dict, kind: T.StructType) -> Column:
    """A valid document with one patch, NULL if that isn't JSON or has a value of another type than its field."""

    @F.pandas_udf(T.StringType())
    def tried(patches: pd.Series) -> pd.Series:
        def one(change: str | None) -> str | None:
            try:
                new = applied(template, step_of(json.loads(change))) if change else None
            except (ValueError, RecursionError):
                return None
            return _dumped(new) if conforms(new, kind) else None

        return pd.Series([one(p) for p in patches], dtype=object)

    return tried(patch)


@F.pandas_udf(T.StringType())
def apply_steps(target: pd.Series, step: pd.Series) -> pd.Series:
    """JSON documents after composed steps; NULL without a step."""
    return pd.Series([None if s is None else _dumped(applied(json.loads(t), json.loads(s))) for t, s in zip(target, step)], dtype=object)


def _folded(parsed: bool):
    """Runs of a document, which come sorted, as one step each. ``parsed``: they are steps already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), None, None
        done: list[tuple] = []

        def table() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = list(zip(*done, strict=True)) if done else [[]] * 4
            names = ["id", "tenant_id", "part", "step"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tenant_id", "step")), strict=True):
                step = json.loads(text)
                step = step if parsed else step_of(step)
                if key == at:
                    held = compose(held, step, True)
                    continue
                if at is not None:
                    done.append((*at, part, _dumped(held)))
                at, held = key, step
            if len(done) > 10_000:
                yield table()
                done.clear()
        if at is not None:
            done.append((*at, part, _dumped(held)))
        yield table()

    return run


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are computed once: written to the scratch folder and read from there."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _parts(stored: DataFrame) -> int:
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // PART_PATCHES))


def fold_patches(patches: DataFrame, order: str = "seq") -> DataFrame:
    """``(id, tenant_id, step)``: all patches of a document, ``(id, tenant_id, <order>, patch)``, as one step."""
    given = _stored(patches.select("id", "tenant_id", F.col(order).alias("seq"), "patch"), "patches")
    return _fold(given, _parts(given))


def _fold(given: DataFrame, parts: int) -> DataFrame:
    """The same for patches that are stored."""
    keys = ["id", "tenant_id", "seq"]
    steps = given.select(*keys, F.col("patch").alias("step"))
    runs = steps.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_folded(False), STEPS_DDL)
    # A row per document and partition: runs of one document lie in partitions next to each other, in order.
    together = runs.repartition("id", "tenant_id").sortWithinPartitions("id", "tenant_id", "part")
    return together.mapInArrow(_folded(True), STEPS_DDL).drop("part")


def _fail(rows: DataFrame, when: Column, kind: str, reason: Column) -> DataFrame:
    """Rows that fail now and haven't before."""
    now = F.col("kind").isNull() & F.coalesce(when, F.lit(False))
    return rows.withColumns({"reason": F.when(now, reason).otherwise(F.col("reason")), "kind": F.when(now, F.lit(kind)).otherwise(F.col("kind"))})


def _looked_up(rows: DataFrame, known: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with the other columns of ``known``, which has each key once. It is stored first, so that a small one is broadcast.

    Rows without a key find nothing. They would all meet in one place, so they get a number of their own as part of the key.
    """
    own = [F.col(k).alias(f"__its_{k}") for k in keys]
    table = _stored(known.select(*own, F.lit(-1).cast("long").alias("__its_turn"), *(c for c in known.columns if c not in keys)), name)
    lacking = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    turn = F.when(lacking, F.pmod(F.xxhash64("id", "tenant_id", "seq"), F.lit(1 << 30))).otherwise(F.lit(-1))
    same = [F.col(k) == F.col(f"__its_{k}") for k in (*keys, "turn")]
    rows = rows.withColumn("turn", turn).join(table, same, "left")
    return rows.drop("turn", *(f"__its_{k}" for k in (*keys, "turn")))


def _tried_alone(patches: DataFrame, template: dict, kind: T.StructType, given: dict[str, Column], stored: DataFrame) -> DataFrame:
    """The patches with what is known of each: ``given``, columns of ``__new``, a valid document with the patch, and the columns of
    ``stored``, a row ``(id, tenant_id, ...)`` per document.

    Requests for a document that isn't there, or without a place in the order of their own, have their ``kind`` and ``reason``.
    """
    columns = ["id", "tenant_id", "seq", "patch"]
    new = patches.select(*columns, F.from_json(_tried(F.col("patch"), template, kind), kind).alias("__new"))
    rows = _stored(new.select(*columns, *(c.alias(name) for name, c in given.items())), "tried")
    place = ["id", "tenant_id", "seq"]
    # Most places are there once, so they are dealt before they are counted: a task holds those of its part.
    dealt = rows.where(F.col("seq").isNotNull()).select(*place).repartition(_parts(rows), *place)
    times = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("__times")).where("__times > 1")
    rows = _looked_up(rows, times, place, "places")
    # Documents are unique by id and tenant; the side of the patches may be hot. A request without a place is no document's.
    known = stored.withColumnsRenamed({"id": "__id", "tenant_id": "__tenant"})
    placed = F.col("seq").isNotNull() & F.col("__times").isNull()
    rows = rows.join(known, (F.col("id") == F.col("__id")) & (F.col("tenant_id") == F.col("__tenant")) & placed, "left")
    rows = rows.withColumn("__lost", F.col("__id").isNull()).drop("__id", "__tenant")
    rows = rows.withColumns({"kind": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    rows = _fail(rows, ~placed, "Validation", F.lit(NO_PLACE))
    return _fail(rows, F.col("__lost"), "ResourceNotFound", F.concat(F.lit("no document '"), F.col("id"), F.lit("'")))


def _claimed(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Refuse names that aren't the document's to take: a name belongs to the document that has it, else to the one whose
    patch asks for it first. Names are claimed for the whole batch; a name that is given up in it isn't free in it.
    ``__name`` is the name that a patch gives, and ``__wanted`` the same for those that are to be judged by it."""
    fits = judged.where(F.col("kind").isNull() & F.col("__name").isNotNull())
    asked = fits.groupBy("tenant_id", "__name").agg(F.min(F.struct("seq", "id")).alias("__first"))
    names = docs.select(F.col(catalog.TENANT).alias("tenant_id"), F.col("resource.name").alias("__name"), F.col(catalog.ID).alias("__holder"))
    owner = asked.join(names, ["tenant_id", "__name"], "left")
    owner = owner.select("tenant_id", "__name", F.coalesce("__holder", "__first.id").alias("__owner"))
    # A name has one owner, so the side of the patches may be hot.
    rows = _looked_up(judged, owner.withColumnRenamed("__name", "__wanted"), ["tenant_id", "__wanted"], "owners")
    return _fail(rows, F.col("__owner") != F.col("id"), "Conflict", F.lit(TAKEN)).drop("__owner")


def _finished(docs: DataFrame, judged: DataFrame, kind: T.StructType, keep: Column | None, now: str | None) -> Change:
    """The next version of the table. The verdicts are written once; tables and rejected rows are read from them."""
    verdicts = _stored(judged.select("id", "tenant_id", "seq", "patch", "kind", "reason"), "verdicts")
    steps = _fold(verdicts.where(F.col("kind").isNull()), _parts(verdicts))
    steps = steps.select(F.col("id").alias("__id"), F.col("tenant_id").alias("__tenant"), "step")
    same = (F.col(catalog.ID) == F.col("__id")) & (F.col(catalog.TENANT) == F.col("__tenant"))
    # One join, so that patches are folded once. Only patched documents go to Python.
    touched = F.col("step").isNotNull()
    after = apply_steps(F.when(touched, F.to_json("resource")), F.col("step"))
    joined = docs.select("metadata", "resource", "status").join(steps, same, "left").withColumn("__new", F.from_json(after, kind))
    stamp = F.when(touched, F.lit(now or catalog.now_text())).otherwise(F.col("metadata.updated_at"))
    resource = F.when(touched, F.col("__new") if keep is None else keep).otherwise(F.col("resource"))
    table = joined.select(F.col("metadata").withField("updated_at", stamp).alias("metadata"), resource.alias("resource"), "status")
    return Change(table, verdicts.where(F.col("kind").isNotNull()))


def patch_in_order(docs: DataFrame, types: DataFrame, patches: DataFrame, global_tenant: str, now: str | None = None) -> Change:
    """Apply ``patches(id, tenant_id, seq, patch)`` to connections one after the other, each judged for itself.

    ``seq`` is the place in the order; a NULL one, or one that two patches of a document share, is rejected. A patch is rejected if the
    document isn't there, it isn't JSON, the result can't be read, holds an inline secret, takes a name that isn't the document's
    (see ``_claimed``) or refers to an unknown type. Id, creation time and status never change.
    """
    docs = _with_reference_only(docs)
    kind = _with_inline_admin(docs.schema["resource"].dataType)
    template = {"name": KEPT, TYPE_ID: KEPT, "format": FORMATS[0], "properties": {}}

    def complete(of: str) -> Column:
        whole = F.col(f"{of}.name").isNotNull() & F.col(f"{of}.{TYPE_ID}").isNotNull() & F.col(f"{of}.properties").isNotNull()
        return F.coalesce(whole & F.col(f"{of}.format").isin(*FORMATS), F.lit(False))

    given = {
        "__whole": complete("__new"),
        "__secret": F.col("__new.admin.secret").isNotNull(),
        "__name": F.nullif(F.col("__new.name"), F.lit(KEPT)),
        "__type": F.nullif(F.col(f"__new.{TYPE_ID}"), F.lit(KEPT)),
    }
    stored = docs.select(F.col(catalog.ID).alias("id"), F.col(catalog.TENANT).alias("tenant_id"), complete("resource").alias("__sound"), F.col(f"resource.{TYPE_ID}").alias("__had"))
    # Types are checked once per document and once per type that patches ask for, instead of once per patch.
    stored = catalog.reference_check(stored, "__had", "tenant_id", _type_ids(types), global_tenant, "__lacks").drop("__had")
    rows = _tried_alone(patches, template, kind, given, stored)
    rows = _fail(rows, ~(F.col("__whole") & F.col("__sound")), "Deserialization", F.lit(UNREADABLE))
    rows = _fail(rows, F.col("__secret"), "Validation", F.lit(PLAIN_SECRET)).withColumn("__wanted", F.when(F.col("kind").isNull(), F.col("__name")))
    asked = rows.where(F.col("kind").isNull() & F.col("__type").isNotNull()).select("tenant_id", "__type").distinct()
    unknown = catalog.reference_check(asked, "__type", "tenant_id", _type_ids(types), global_tenant, "__missing").where(F.col("__missing").isNotNull())
    rows = _looked_up(rows, unknown, ["tenant_id", "__type"], "unknown-types")
    rows = _fail(rows, F.col("__missing").isNotNull(), "ResourceNotFound", F.col("__missing"))
    judged = _claimed(docs, rows)
    # The stored type may be unknown; then patches wait for the first accepted one that gives a type.
    waiting = F.col("kind").isNull() & F.col("__lacks").isNotNull()
    first = judged.where(waiting & F.col("__type").isNotNull()).groupBy("id", "tenant_id").agg(F.min("seq").alias("__since"))
    judged = _looked_up(judged, first, ["id", "tenant_id"], "first-types")
    early = F.col("__type").isNull() & (F.col("__since").isNull() | (F.col("seq") < F.col("__since")))
    judged = _fail(judged, F.col("__lacks").isNotNull() & early, "ResourceNotFound", F.col("__lacks"))
    reference = F.when(F.col("__new.admin").isNotNull(), F.struct(F.col("__new.admin.secret_ref").alias("secret_ref")))
    return _finished(docs, judged, kind, F.col("__new").withField("admin", reference), now)


def patch_types(docs: DataFrame, patches: DataFrame, now: str | None = None) -> Change:
    """Apply ``patches(id, tenant_id, seq, patch)`` to connection types one after the other, each judged for itself.

    A text as provider has to be one of the known ones; name, provider and the list of credential fields (where types have one)
    have to stay. Status and times of creation never change; names are claimed as for connections.
    """
    kind = docs.schema["resource"].dataType
    template = {"name": KEPT, "provider": catalog.PROVIDERS[0], "credentials_fields": []}
    needed = [f for f in template if f in kind.names]

    def complete(of: str) -> Column:
        whole = F.col(f"{of}.{needed[0]}").isNotNull()
        for field in needed[1:]:
            whole = whole & F.col(f"{of}.{field}").isNotNull()
        return F.coalesce(whole, F.lit(False))

    given = {"__whole": complete("__new"), "__provider": F.col("__new.provider"), "__name": F.nullif(F.col("__new.name"), F.lit(KEPT))}
    stored = docs.select(F.col(catalog.ID).alias("id"), F.col(catalog.TENANT).alias("tenant_id"), complete("resource").alias("__sound"))
    rows = _tried_alone(patches, template, kind, given, stored)
    checked = catalog.validate_domain(rows.withColumnRenamed("reason", "__reason"), "__provider")
    checked = checked.withColumnsRenamed({"reason": "__unknown", "__reason": "reason"})
    rows = _fail(checked, F.col("__provider").isNotNull() & F.col("__unknown").isNotNull(), "Validation", F.col("__unknown"))
    rows = _fail(rows, ~(F.col("__whole") & F.col("__sound")), "Deserialization", F.lit(UNREADABLE)).withColumn("__wanted", F.when(F.col("kind").isNull(), F.col("__name")))
    return _finished(docs, _claimed(docs, rows), kind, None, now)
