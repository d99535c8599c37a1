from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirgate.operators import catalog, lifecycle, patching
from weirgate.streaming.seeding import apply_batch, watch_seeds

STAMP, LATER = "2026-01-01T00:00:00Z", "2026-02-02T00:00:00Z"
META = "metadata struct<id: string, tenant_id: string, created_at: string, updated_at: string>"
RESOURCE = "resource struct<name: string, data_connection_type_id: string, format: string, admin: {}, properties: map<string, string>>"
STORED = f"{META}, {RESOURCE.format('struct<secret_ref: string>')}, status {catalog.STATUS_TYPE}"
INLINE = "struct<secret_ref: string, name: string, secret: map<string, string>>"
TYPES = f"{META}, resource struct<name: string, provider: string, description: string>, status struct<capabilities: struct<flight: boolean, rest: boolean>>"
OK = ("ready", None, [])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (("c1", "red", STAMP, STAMP), ("one", "t1", "tabular", ("s1",), {"a": "1"}), OK),
        (("c2", "blue", STAMP, STAMP), ("two", "t1", "tabular", None, {}), OK),
    ]
    return spark.createDataFrame(rows, STORED)


@pytest.fixture(scope="module")
def types(spark):
    rows = [
        (("t1", "global", STAMP, STAMP), ("pg", "postgres", None), ((False, True),)),
        (("t2", "blue", STAMP, STAMP), ("own", "s3", None), ((True, False),)),
        (("t3", "blue", STAMP, STAMP), ("old", "ftp", None), ((True, False),)),
    ]
    return spark.createDataFrame(rows, TYPES)


def test_create(spark, docs, types):
    rows = [
        (("new", "t1", "tabular", (None, "sec", {"k": "v"}), {}), "red", 1),
        (("one", "t1", "tabular", (None, "sec2", {"k": "v"}), {}), "red", 2),
        (("x", "t2", "tabular", (None, "sec3", {"k": "v"}), {}), "red", 3),
        (("x", "t2", "binary", None, {}), "blue", 4),
        (("new", "t1", "tabular", ("ref", None, None), {}), "red", 5),
    ]
    requests = spark.createDataFrame(rows, f"{RESOURCE.format(INLINE)}, tenant_id string, seq long")
    change = lifecycle.create_connections(docs, types, requests, "global", now=LATER)
    table = {(r["resource"]["name"], r["metadata"]["tenant_id"]): r for r in change.table.collect()}
    assert set(table) == {("one", "red"), ("two", "blue"), ("new", "red"), ("x", "blue")}
    assert table["new", "red"]["resource"]["admin"]["secret_ref"] == "sec"
    assert table["x", "blue"]["resource"]["admin"] is None
    assert {(r["seq"], r["kind"]) for r in change.rejected.collect()} == {(2, "Conflict"), (3, "ResourceNotFound"), (5, "Conflict")}
    assert [(r["name"], r["namespace"]) for r in change.secrets.collect()] == [("sec", "red")]


def test_create_types(spark, types):
    rows = [(("pg2", "postgres", None), "red", 1), (("b", "bogus", None), "red", 2), (("own", "s3", None), "blue", 3)]
    requests = spark.createDataFrame(rows, "resource struct<name: string, provider: string, description: string>, tenant_id string, seq long")
    change = lifecycle.create_types(types, requests)
    assert change.table.count() == 4
    assert change.table.where("resource.name = 'pg2'").first()["status"]["capabilities"].asDict() == {"flight": False, "rest": False}
    assert {(r["seq"], r["kind"]) for r in change.rejected.collect()} == {(2, "Validation"), (3, "Conflict")}


@pytest.mark.parametrize(
    ("key", "patch", "kind"),
    [
        (("c1", "red"), '{"name":"uno","properties":{"host":"h","a":null}}', None),
        (("c1", "red"), '{"admin":null}', None),
        (("c1", "red"), '{"data_connection_type_id":"t2"}', "ResourceNotFound"),
        (("c1", "red"), '{"admin":{"secret_ref":null,"name":"n","secret":{"k":"v"}}}', "Validation"),
        (("c1", "red"), '{"name":null}', "Deserialization"),
        (("c1", "red"), '{"format":"other"}', "Deserialization"),
        (("c1", "blue"), '{"name":"x"}', "ResourceNotFound"),
    ],
)
def test_patch(spark, docs, types, key, patch, kind):
    patches = spark.createDataFrame([(*key, patch)], "id string, tenant_id string, patch string")
    change = lifecycle.patch_connections(docs, types, patches, "global", now=LATER)
    assert [r["kind"] for r in change.rejected.collect()] == ([kind] if kind else [])
    table = {r["metadata"]["id"]: r for r in change.table.collect()}
    before = {r["metadata"]["id"]: r for r in docs.collect()}
    assert table["c2"] == before["c2"]
    if kind:
        assert table["c1"] == before["c1"]
        return
    after = table["c1"]
    assert (after["metadata"]["created_at"], after["metadata"]["updated_at"]) == (STAMP, LATER)
    assert after["status"] == before["c1"]["status"]
    if "uno" in patch:
        assert after["resource"]["name"] == "uno" and after["resource"]["properties"] == {"host": "h"}
        assert after["resource"]["format"] == "tabular" and after["resource"]["admin"]["secret_ref"] == "s1"
    else:
        assert after["resource"]["admin"] is None


def test_delete(spark, docs):
    keys = spark.createDataFrame([("c1", "red"), ("c2", "red")], "id string, tenant_id string")
    change = lifecycle.delete_documents(docs, keys)
    assert [r["metadata"]["id"] for r in change.table.collect()] == ["c2"]
    assert [(r["id"], r["kind"]) for r in change.rejected.collect()] == [("c2", "ResourceNotFound")]


def test_audit(types):
    table, changed = lifecycle.audit_types(types, ["postgres", "s3"])
    assert {(r["metadata"]["id"], tuple(r["status"]["capabilities"])) for r in table.collect()} == {("t1", (True, True)), ("t2", (True, False)), ("t3", (False, False))}
    assert {r["metadata"]["id"] for r in changed.collect()} == {"t1", "t3"}


def test_seeds_that_keep_arriving(spark, tmp_path):
    schema = "seq long, name string, phase string"
    drops = str(tmp_path / "drops")

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drops)

    def run():
        stream = spark.readStream.schema(schema).parquet(drops)
        query = watch_seeds(stream, str(tmp_path / "table"), str(tmp_path / "outcome"), str(tmp_path / "ck"), ["name"], "seq", available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    def names():
        return sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "table")).collect())

    drop([(1, "a", None), (2, "a", None), (3, "b", "Completed")])
    run()
    assert names() == ["a"]
    drop([(4, "a", None), (5, "c", "Pending")])
    run()
    assert names() == ["a", "c"]
    run()
    assert names() == ["a", "c"]
    outcome = spark.read.parquet(str(tmp_path / "outcome")).groupBy("phase").agg(F.collect_set("seq").alias("s")).collect()
    assert {r["phase"]: set(r["s"]) for r in outcome} == {"Completed": {1, 3, 5}, "AlreadyExists": {2, 4}}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table, outcome = str(tmp_path / "table"), str(tmp_path / "outcome")
    batches = [[(1, "a", None), (2, "b", None)], [(3, "a", None), (4, "c", None)]]

    def state():
        return [sorted(map(tuple, spark.read.parquet(p).collect())) for p in (table, outcome)]

    for epoch, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "seq long, name string, phase string")
        apply_batch(batch, epoch, table, outcome, ["name"], "seq")
        before = state()
        apply_batch(batch, epoch, table, outcome, ["name"], "seq")
        assert state() == before
    assert sorted(r["name"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_patches_that_take_a_name_or_meet_another(spark, docs, types):
    third = [(("c3", "red", STAMP, STAMP), ("three", "t1", "tabular", None, {}), OK)]
    docs = docs.unionByName(spark.createDataFrame(third, STORED))
    rows = docs.select("metadata.id", "metadata.tenant_id", "resource.name").collect()
    tenant = "red"
    one, two = sorted(r for r in rows if r.tenant_id == tenant)
    taken = [(one.id, tenant, json.dumps({"name": two.name}))]
    twice = [(one.id, tenant, '{"name": "x"}'), (one.id, tenant, '{"name": "y"}')]
    both = [(one.id, tenant, '{"name": "x"}'), (two.id, tenant, '{"name": "x"}')]
    before = sorted(map(tuple, rows))
    for patches in (taken, twice, both):
        change = lifecycle.patch_connections(docs, types, spark.createDataFrame(patches, "id string, tenant_id string, patch string"), "global", now=LATER)
        assert sorted(map(tuple, change.table.select("metadata.id", "metadata.tenant_id", "resource.name").collect())) == before
        assert [(r.kind, r.patch) for r in change.rejected.orderBy("patch", "id").collect()] == [("Conflict", p) for *_, p in patches]


def test_requests_without_a_seq_of_their_own(spark, docs, types):
    rows = [((n, "t1", "tabular", None, {}), "red", seq) for n, seq in (("p", 1), ("q", 1), ("r", None), ("s", 2))]
    requests = spark.createDataFrame(rows, f"{RESOURCE.format(INLINE)}, tenant_id string, seq long")
    change = lifecycle.create_connections(docs, types, requests, "global", now=LATER)
    assert sorted(r["resource"]["name"] for r in change.table.collect()) == ["one", "s", "two"]
    refused = sorted((r["resource"]["name"], r["kind"], r["reason"]) for r in change.rejected.collect())
    assert refused == [(n, "Validation", lifecycle.NO_PLACE) for n in "pqr"]


def test_a_name_that_is_free_again_gets_a_new_id(spark, docs, types):
    rows = [(("a", "t1", "tabular", None, {}), "red", 1)]
    requests = spark.createDataFrame(rows, f"{RESOURCE.format(INLINE)}, tenant_id string, seq long")
    first = lifecycle.create_connections(docs, types, requests, "global", now=LATER).table
    name = F.when(F.col("resource.name") == "a", F.lit("z")).otherwise(F.col("resource.name"))
    renamed = first.withColumn("resource", F.col("resource").withField("name", name))
    again = lifecycle.create_connections(renamed, types, requests, "global", now=LATER).table
    ids = [r["id"] for r in again.select("metadata.id").collect()]
    assert len(ids) == len(set(ids)) == 4


def in_turn(docs, types, patches):
    """The reference's way: one patch after the other, each on what the ones before it left."""
    table = {(d["metadata"]["id"], d["metadata"]["tenant_id"]): json.loads(json.dumps(d["resource"])) for d in docs}
    verdicts = {}
    for key, tenant, seq, patch in sorted(patches, key=lambda p: p[2]):
        old = table.get((key, tenant))
        new = patching.applied(old, patching.step_of(json.loads(patch))) if old is not None else None
        shape = new is not None and isinstance(new, dict) and all(isinstance(new.get(k), str) for k in ("name", "data_connection_type_id"))
        shape = shape and new.get("format") in ("tabular", "binary") and isinstance(new.get("properties"), dict)
        admin = new.get("admin") if shape else None
        if old is None:
            verdict = "ResourceNotFound"
        elif not shape or not (admin is None or isinstance(admin, dict)):
            verdict = "Deserialization"
        elif admin and admin.get("secret") is not None:
            verdict = "Validation"
        elif any(k != (key, tenant) and k[1] == tenant and d["name"] == new["name"] for k, d in table.items()):
            verdict = "Conflict"
        elif new["data_connection_type_id"] not in types:
            verdict = "ResourceNotFound"
        else:
            verdict, table[key, tenant] = None, new
        verdicts[key, seq] = verdict
    return table, verdicts


def test_patches_in_turn(spark, types):
    resource = {"name": "one", "data_connection_type_id": "t1", "format": "tabular", "admin": {"secret_ref": "s1"}, "properties": {"a": "1"}}
    stored = [(("c1", "red", STAMP, STAMP), resource, OK), (("c2", "red", STAMP, STAMP), resource | {"name": "two", "data_connection_type_id": "gone"}, OK)]
    docs = spark.createDataFrame(stored, STORED)
    steps = [
        ("c1", '{"properties":{"b":"2","a":null}}'),
        ("c2", '{"properties":{"x":"1"}}'),
        ("c1", '{"name":null}'),
        ("c1", '{"properties":null}'),
        ("c1", '{"properties":{"a":"3"}}'),
        ("c1", '{"name":"two"}'),
        ("c1", '{"admin":null}'),
        ("c1", '{"admin":{"secret_ref":"s2"}}'),
        ("c2", '{"data_connection_type_id":"nowhere"}'),
        ("c2", '{"data_connection_type_id":"t1"}'),
        ("c2", '{"properties":{"x":"2"}}'),
        ("c1", '{"admin":{"secret_ref":null,"name":"n","secret":{"k":"v"}}}'),
        ("c1", '{"name":"uno"}'),
        ("c1", '{"name":"dos","properties":{"a":null}}'),
        ("c1", '{"format":"other"}'),
        ("c2", '{"name":"dos"}'),
        ("c1", "7"),
        ("c3", "{}"),
        ("c1", '{"name":5}'),
        ("c2", '{"admin":"text"}'),
    ]
    asked = [(key, "red", seq, patch) for seq, (key, patch) in enumerate(steps)]
    want, verdicts = in_turn([{"metadata": {"id": m[0], "tenant_id": m[1]}, "resource": r} for m, r, _ in stored], {"t1"}, asked)
    odd = [("c1", "red", None, "{}"), ("c1", "red", 100, "{}"), ("c1", "red", 100, "{}"), ("c1", "red", 101, "{"), ("c1", "red", 102, None)]
    patches = spark.createDataFrame(asked + odd, "id string, tenant_id string, seq long, patch string")
    change = patching.patch_in_order(docs, types, patches, "global", now=LATER)
    table = {r["metadata"]["id"]: r for r in change.table.collect()}
    for (key, _), resource in want.items():
        got = table[key]["resource"].asDict(recursive=True)
        assert got == {"admin": None} | resource
        assert (table[key]["metadata"]["updated_at"], table[key]["metadata"]["created_at"]) == (LATER, STAMP)
    got = {(r["id"], r["seq"]): r["kind"] for r in change.rejected.where("seq < 100").collect()}
    assert got == {k: v for k, v in verdicts.items() if v}
    odd = change.rejected.where("seq IS NULL OR seq >= 100").collect()
    assert sorted((r["seq"] or 0, r["kind"]) for r in odd) == [(0, "Validation"), (100, "Validation"), (100, "Validation"), (101, "Deserialization"), (102, "Deserialization")]
    nothing = patching.patch_in_order(docs, types, patches.where("false"), "global", now=LATER)
    assert nothing.rejected.count() == 0 and sorted(r["metadata"]["updated_at"] for r in nothing.table.collect()) == [STAMP, STAMP]


def test_names_are_claimed_by_the_first_patch(spark, docs, types):
    more = [(("c3", "red", STAMP, STAMP), ("three", "t1", "tabular", None, {}), OK)]
    docs = docs.unionByName(spark.createDataFrame(more, STORED))
    asked = [("c3", "red", 1, "n"), ("c1", "red", 2, "n"), ("c2", "blue", 3, "n"), ("c3", "red", 4, "m"), ("c1", "red", 5, "three"), ("c1", "red", 6, "one")]
    patches = spark.createDataFrame([(k, t, s, json.dumps({"name": n})) for k, t, s, n in asked], "id string, tenant_id string, seq long, patch string")
    change = patching.patch_in_order(docs, types, patches, "global", now=LATER)
    assert {r["metadata"]["id"]: r["resource"]["name"] for r in change.table.collect()} == {"c1": "one", "c2": "n", "c3": "m"}
    assert sorted((r["seq"], r["kind"]) for r in change.rejected.collect()) == [(2, "Conflict"), (5, "Conflict")]


def test_each_patch_is_read_once(spark, types):
    """Verdicts are several joins; what they join is computed, and tried in Python, once."""
    stored = [((f"c{i}", "red", STAMP, STAMP), {"name": f"n{i}", "data_connection_type_id": "t1", "format": "tabular", "admin": None, "properties": {}}, OK) for i in range(20)]
    docs = spark.createDataFrame(stored, STORED)
    texts = ['{"name":"shared"}', '{"data_connection_type_id":"t1"}', '{"properties":{"a":"b"}}', '{"name":null}']
    asked = spark.createDataFrame([(f"c{i % 20}", "red", i, texts[i // 20 % 4]) for i in range(400)], "id string, tenant_id string, seq long, patch string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    change = patching.patch_in_order(docs, types, asked.mapInPandas(counted, asked.schema), "global", now=LATER)
    assert change.table.count() == 20 and change.rejected.count() == 100 + 95
    assert read.value == 400


def test_documents_that_come_twice_leave_requests_without_a_place_as_they_are(spark, docs, types):
    twice = docs.unionByName(docs)
    asked = [("c1", 1, "{}"), ("c1", 1, "{}"), ("c1", None, "{}"), ("c1", 2, '{"name":"c1","format":null}')]
    patches = spark.createDataFrame([(k, "red", s, p) for k, s, p in asked], "id string, tenant_id string, seq long, patch string")
    rejected = patching.patch_in_order(twice, types, patches, "global", now=LATER).rejected.where("kind = 'Validation'").collect()
    assert sorted(str(r.seq) for r in rejected) == ["1", "1", "None"]


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(4000).select(F.lit("d").alias("id"), F.lit("red").alias("tenant_id"), F.col("id").alias("seq"), F.when(F.col("id") == 7, "n").alias("__name"))
    known = spark.createDataFrame([("red", "n", "d9")], "tenant_id string, __name string, __owner string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("-1", "false", "8")):
            spark.conf.set(key, value)
        found = patching._looked_up(rows, known, ["tenant_id", "__name"], "owners")
        assert [(r.seq, r["__owner"]) for r in found.where("__owner IS NOT NULL").collect()] == [(7, "d9")]
        sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / 8
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_patch_types(spark, types):
    asked = [
        ("t1", "global", 1, '{"name":"MySQL"}', None),
        ("t1", "global", 2, '{"provider":"bogus"}', "Validation"),
        ("t1", "global", 3, '{"provider":null}', "Deserialization"),
        ("t1", "global", 4, '{"provider":5}', "Deserialization"),
        ("t1", "global", 5, '{"provider":"s3","description":"d"}', None),
        ("t1", "global", 6, '{"description":null}', None),
        ("t9", "global", 7, '{"name":"x"}', "ResourceNotFound"),
        ("t1", "blue", 8, '{"name":"x"}', "ResourceNotFound"),
        ("t2", "blue", 9, '{"name":"old"}', "Conflict"),
    ]
    patches = spark.createDataFrame([a[:4] for a in asked], "id string, tenant_id string, seq long, patch string")
    change = patching.patch_types(types, patches, now=LATER)
    table = {r["metadata"]["id"]: r for r in change.table.collect()}
    assert tuple(table["t1"]["resource"]) == ("MySQL", "s3", None)
    assert tuple(table["t1"]["status"]["capabilities"]) == (False, True)
    assert table["t2"]["metadata"]["updated_at"] == STAMP and table["t1"]["metadata"]["updated_at"] == LATER
    assert {(r["seq"], r["kind"]) for r in change.rejected.collect()} == {(a[2], a[4]) for a in asked if a[4]}


JSON = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@given(JSON.filter(lambda x: x is not None), st.lists(JSON, min_size=2, max_size=5))
def test_steps_compose(document, patches):
    one_by_one = document
    for patch in patches:
        one_by_one = catalog._merged(one_by_one, patch)
    steps = [patching.step_of(p) for p in patches]
    left = right = steps[0]
    for step in steps[1:]:
        left = patching.compose(left, step)
    right = steps[-1]
    for step in steps[-2::-1]:
        right = patching.compose(step, right)
    assert patching.applied(document, left) == patching.applied(document, right) == one_by_one
    held = patching.step_of(patches[0])
    for patch in patches[1:]:
        held = patching.compose(held, patching.step_of(patch), True)
    assert held == left


def test_a_hot_document_is_folded_in_many_tasks(spark):
    n = 60_000
    text = F.concat(F.lit('{"properties":{"k'), F.col("id") % 10, F.lit('":"'), F.col("id"), F.lit('"}}'))
    patches = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5000)).alias("id"), F.lit("red").alias("tenant_id"), F.col("id").alias("seq"), text.alias("patch"))
    folded = patching.fold_patches(patches)
    steps = {r.id: json.loads(r.step) for r in folded.collect()}
    hot = patching.applied({}, steps["hot"])["properties"]
    assert hot == {f"k{k}": str(max(i for i in range(0, n, 3) if i % 10 == k)) for k in range(10)} and len(steps) == 5001
    parts = spark.sparkContext.defaultParallelism
    ranges = patches.repartitionByRange(parts, "id", "tenant_id", "seq").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in ranges) < 2.5 * n / parts


def test_batches_read_their_own_seeds_alone(spark, tmp_path):
    """Five batches with a restart after each; the outcomes are those of one pass, and no batch reads an earlier one."""
    drops, places = str(tmp_path / "drops"), [str(tmp_path / n) for n in ("table", "outcome", "checkpoint")]
    schema = "seq long, name string, kind int, phase string"
    rows = [(i, None if i % 50 == 7 else "hot" if i % 3 == 0 else f"n{i % 90}", i % 2, "Completed" if i % 11 == 0 else None) for i in range(1500)]
    read, wanted, seen = [], {}, set()
    for batch in range(5):
        own = rows[batch * 300 : (batch + 1) * 300]
        for seq, name, kind, phase in own:
            added = phase is None and (name, kind) not in seen
            seen |= {(name, kind)} if added else set()
            wanted[seq] = (added, "Completed" if added or phase else "AlreadyExists")
        spark.createDataFrame(own[::-1], schema).repartition(3).coalesce(1).write.mode("append").parquet(drops)
        stream = spark.readStream.schema(schema).parquet(drops)
        query = watch_seeds(stream, *places, ["name", "kind"], "seq", available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert read == [300] * 5
    got = {r["seq"]: (r["added"], r["phase"]) for r in spark.read.parquet(places[1]).collect()}
    assert got == wanted
    table = spark.read.parquet(places[0]).select("seq", "phase").collect()
    assert sorted((r["seq"], r["phase"]) for r in table) == [(s, "Completed") for s, (added, _) in sorted(wanted.items()) if added]
