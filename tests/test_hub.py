from __future__ import annotations

import json
import sqlite3

import pytest

from weirgate import Hub
from weirgate.operators import codes, postings
from weirgate.errors import ConfigError, InvalidRequest, NotFound, SecretNotFound, SourceUnavailable

STAMP = "2026-01-01T00:00:00Z"
META = "metadata struct<id: string, tenant_id: string, created_at: string, updated_at: string>"
CONN = f"{META}, resource struct<name: string, data_connection_type_id: string, format: string, admin: struct<secret_ref: string>, properties: map<string, string>>"
TYPE = f"{META}, resource struct<name: string, provider: string, description: string>"


RAW_MAPPING = {"raw": {"mappings": {"properties": {"name": {"type": "keyword"}, "n": {"type": "byte"}, "at": {"type": "date"}, "o": {"properties": {"k": {"type": "text"}}}}}}}


@pytest.fixture(scope="module")
def hub(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hub")
    db = str(folder / "x.db")
    connection = sqlite3.connect(db)
    connection.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, "y")])
    connection.commit()
    connection.close()
    (folder / "rows.csv").write_text("id,category,prompt\n1,factuality_csv,p\n2,reasoning_csv,q\n3,safety_csv,r\n")
    spark.createDataFrame([(1, ["P"], ("Ann",)), (2, ["P"], ("Bob",))], "id long, labels array<string>, properties struct<name: string>").write.parquet(str(folder / "nodes.parquet"))
    spark.createDataFrame([(1, 1, 2, "KNOWS", (7,))], "id long, src long, dst long, typ string, properties struct<since: int>").write.parquet(str(folder / "edges.parquet"))

    raw = [('{"name":"a","n":1,"at":1700000000000,"o":{"k":"v"}}',), ('{"name":"b","n":"1"}',), ('{"name":"c","n":300}',)]
    spark.createDataFrame(raw, "doc string").write.parquet(str(folder / "raw.parquet"))
    tables = f"{sf_dir}/{{name}}.parquet"
    entries = {
        "pg": ("postgres", {"location": tables, "tables": "orders, customer"}, None),
        "pg_no_url": ("postgres", {}, None),
        "lite": ("sqlite", {}, "lite-secret"),
        "lake": ("s3", {"location": str(folder)}, None),
        "lake_hint": ("s3", {"location": str(folder), "format": "CSV"}, None),
        "docs": ("elasticsearch", {"location": tables, "index": "documents", "id_field": "doc_id"}, None),
        "two": ("elasticsearch", {"location": tables, "id_field": "doc_id"}, None),
        "raw": ("elasticsearch", {"location": str(folder / "{name}.parquet"), "index": "raw", "id_field": "name", "mapping": json.dumps(RAW_MAPPING)}, None),
        "views": ("elasticsearch", {"id_field": "doc_id"}, None),
        "vectors": ("milvus", {"location": tables, "primary_key": "vec_id"}, None),
        "graph": ("neo4j", {"location": str(folder / "{name}.parquet")}, None),
        "hf": ("huggingface", {}, None),
        "no_secret": ("sqlite", {}, "lost"),
        "no_type": ("unknown", {}, None),
    }
    conns = [((k, "team", STAMP, STAMP), (k, f"type-{p}", "tabular", (s,) if s else None, props)) for k, (p, props, s) in entries.items()]
    kinds = ["postgres", "sqlite", "s3", "elasticsearch", "milvus", "neo4j", "huggingface"]
    types = [((f"type-{p}", "global", STAMP, STAMP), (p, p, None)) for p in kinds]
    secrets = spark.createDataFrame([("lite-secret", "team", {"URL": f"sqlite://{db}"})], "name string, namespace string, properties map<string, string>")
    return Hub(spark, spark.createDataFrame(conns, CONN), spark.createDataFrame(types, TYPE), "team", secrets=secrets)


def test_sql(hub):
    text = "SELECT c_mktsegment, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = :s GROUP BY 1"
    assert hub.read(text, "pg", {"s": "O"}).count() == 5
    described = hub.describe(text, "pg", {"s": "O"}).orderBy("position").collect()
    assert [(r["name"], r["type"]) for r in described] == [("c_mktsegment", "string"), ("n", "bigint")]
    assert sum(b.num_rows for b in hub.read_batches("SELECT * FROM customer", "pg", batch_size=64)) == 150


def test_secret_and_sqlite(hub):
    assert [tuple(r) for r in hub.read("SELECT a, b FROM t", "lite").orderBy("a").collect()] == [(1, "x"), (2, "y")]
    assert list(hub.read_pandas("SELECT b FROM t", "lite")["b"]) == ["x", "y"]
    with pytest.raises(SecretNotFound):
        hub.read("SELECT 1", "no_secret")
    with pytest.raises(InvalidRequest):
        hub.read("SELECT ?", "lite", [1])


def test_objects(hub):
    assert [r["category"] for r in hub.read("rows.csv", "lake").orderBy("id").collect()] == ["factuality_csv", "reasoning_csv", "safety_csv"]
    assert hub.read("rows.csv", "lake_hint").count() == 3
    with pytest.raises(InvalidRequest):
        hub.read("rows.json", "lake")


def test_documents(hub):
    body = {"query": {"term": {"lang": "fr"}}, "_source": ["doc_id", "lang"], "sort": [{"doc_id": "desc"}], "size": 2}
    rows = hub.read(json.dumps(body), "docs").collect()
    assert len(rows) == 2 and rows[0]["doc_id"] > rows[1]["doc_id"]
    assert rows[0]["text"] is None and rows[0]["lang"] == "fr"
    both = hub.read(json.dumps({"index": "documents,labels", "_source": ["doc_id", "quality"]}), "two")
    assert {"doc_id", "text", "quality", "toxic"} <= set(both.columns)
    with pytest.raises(InvalidRequest):
        hub.read('{"query": {"match_all": {}}}', "two")


def test_vectors(hub):
    request = {"collectionName": "embeddings", "id": [3, 5], "outputFields": ["vec_id", "label"]}
    assert sorted(r["vec_id"] for r in hub.read(json.dumps(request), "vectors").collect()) == [3, 5]


def test_graph(hub):
    text = "SELECT a.properties.name x, b.properties.name y FROM nodes a JOIN edges e ON e.src = a.id JOIN nodes b ON e.dst = b.id"
    assert [tuple(r) for r in hub.read(text, "graph").collect()] == [("Ann", "Bob")]


@pytest.mark.parametrize(
    ("name", "error"),
    [("nope", NotFound), ("no_type", NotFound), ("hf", ConfigError), ("pg_no_url", SourceUnavailable)],
)
def test_errors(hub, name, error):
    with pytest.raises(error):
        hub.read("SELECT 1", name)


def test_other_tenant_sees_nothing(hub):
    other = Hub(hub.spark, hub.connections, hub.types, "other")
    with pytest.raises(NotFound):
        other.read("SELECT 1", "pg")


def test_index_patterns(spark, hub, sf_dir):
    for name in ("ix_labels", "ix_documents"):
        spark.read.parquet(f"{sf_dir}/{name[3:]}.parquet").createOrReplaceTempView(name)
    plain = {"index": "ix_*", "_source": ["doc_id"]}
    frames = hub.connection("views").names(spark, plain["index"])
    assert frames == ["ix_documents", "ix_labels"]
    assert {"text", "toxic"} <= set(hub.read(json.dumps(plain), "views").columns)
    with pytest.raises(NotFound):
        hub.read(json.dumps(plain), "two")
    under = hub.read(json.dumps({"index": "doc*,label?", "_source": ["doc_id"]}), "two")
    counts = [spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("documents", "labels")]
    assert {"text", "toxic"} <= set(under.columns) and under.count() == sum(counts)
    assert hub.connection("two").names(spark, "n*,reg*") == ["nation", "region"]
    with pytest.raises(NotFound):
        hub.read('{"index": "no_such_*"}', "views")


def test_stored_indexes_serve_searches(spark, hub, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    postings.build_text_index(docs, "doc_id", ["text"], str(tmp_path / "documents"))
    codes.build_code_index(vectors, "embedding", "vec_id", str(tmp_path / "embeddings"))
    entries = {
        "docs": ("elasticsearch", {"location": f"{sf_dir}/{{name}}.parquet", "index": "documents", "id_field": "doc_id", "text_index_location": str(tmp_path / "{name}")}),
        "vectors": ("milvus", {"location": f"{sf_dir}/{{name}}.parquet", "primary_key": "vec_id", "code_index_location": str(tmp_path / "{name}")}),
    }
    conns = [((k, "team", STAMP, STAMP), (k, f"type-{p}", "tabular", None, props)) for k, (p, props) in entries.items()]
    served = Hub(spark, spark.createDataFrame(conns, CONN), hub.types, "team")
    body = '{"query": {"match_phrase": {"text": "of the"}}, "_source": ["doc_id"]}'
    assert sorted(r.doc_id for r in served.read(body, "docs").collect()) == sorted(r.doc_id for r in hub.read(body, "docs").collect())
    first = [float(x) for x in vectors.orderBy("vec_id").first()["embedding"]]
    request = json.dumps({"collectionName": "embeddings", "data": [first], "annsField": "embedding", "limit": 5, "outputFields": ["vec_id", "label"]})
    assert [tuple(r) for r in served.read(request, "vectors").collect()] == [tuple(r) for r in hub.read(request, "vectors").collect()]


def test_listing(hub):
    listed = hub.list_connections()
    assert listed.count() == listed.first()["total_count"] == 14
    assert {"id", "name", "properties", "created_at"} <= set(listed.columns)
    types = hub.list_types().collect()
    assert {r["tenant_id"] for r in types} == {""} and "neo4j" in {r["provider"] for r in types}


def test_json_documents(hub):
    out = hub.read('{"sort": ["name"], "size": 5}', "raw")
    assert out.schema.simpleString() == "struct<name:string,n:tinyint,at:timestamp,o.k:string>"
    assert [(r["name"], r["n"], r["o.k"]) for r in out.collect()] == [("a", 1, "v"), ("b", None, None), ("c", 44, None)]
    assert hub.read('{"query": {"term": {"o.k": "v"}}}', "raw").count() == 1
