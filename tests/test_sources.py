from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weirgate.errors import ConfigError, InvalidRequest, NoData, SourceUnavailable, SqlError
from weirgate.sources import export, files, jdbc, sqlite, sqltext

CSV = "id,name,score,active\n1,alice,95.5,true\n2,bob,87.0,false\n3,charlie,92.3,true\n4,diana,88.1,true\n5,eve,76.4,false\n"
JSONL = "".join(
    json.dumps({"id": i, "name": n, "score": s, "active": a}) + "\n"
    for i, n, s, a in [(1, "alice", 95.5, True), (2, "bob", 87.0, False), (3, "charlie", 92.3, True), (4, "diana", 88.1, True), (5, "eve", 76.4, False)]
)
SCHEMA = "struct<id:bigint,name:string,score:double,active:boolean>"


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    ("path", "hint", "expected"),
    [
        ("a/b.parquet", None, "parquet"),
        ("a/B.CSV", None, "csv"),
        ("x.jsonl", None, "jsonl"),
        ("x.NDJSON", None, "jsonl"),
        ("x.jsonlines", None, "jsonl"),
        ("x.csv", "Parquet", "parquet"),
        ("x", "JSONL", "jsonl"),
    ],
)
def test_detect_format(path, hint, expected):
    assert files.detect_format(path, hint) == expected


@pytest.mark.parametrize(("path", "hint"), [("x.json", None), ("x", None), ("x.parquet", "xml"), ("x.json", "json")])
def test_detect_format_rejects(path, hint):
    with pytest.raises(InvalidRequest):
        files.detect_format(path, hint)


def test_csv_sample(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "sample.csv", CSV))
    assert df.schema.simpleString() == SCHEMA
    assert [r["name"] for r in df.orderBy("id").collect()] == ["alice", "bob", "charlie", "diana", "eve"]


def test_csv_types_and_quotes(spark, tmp_path):
    text = 'd,ts,z,mixed,empty,q\n2024-01-02,2024-01-02T03:04:05,2024-01-02T03:04:05Z,1,,"a ""b"", c\\"\n,2024-01-02 03:04:05.5,,x,,\n'
    df = files.read_csv(spark, write(tmp_path / "t.csv", text))
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    assert kinds == ["date", "timestamp_ntz", "timestamp", "string", "string", "string"]
    first, second = df.orderBy("mixed").collect()
    assert first["q"] == 'a "b", c\\'
    assert second["q"] is None and second["d"] is None


def test_csv_bad_value_fails(spark, tmp_path):
    rows = "".join(f"{i},{'x' * 100}\n" for i in range(12_000))
    path = write(tmp_path / "late.csv", "id,name\n" + rows + "oops,y\n")
    assert dict(files.read_csv(spark, path).dtypes)["id"] == "string"
    df = files.read_csv(spark, path, files.T.StructType.fromDDL("id bigint, name string"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        df.collect()


def test_csv_other_header_fails(spark, tmp_path):
    write(tmp_path / "a.csv", CSV)
    write(tmp_path / "b.csv", CSV.replace("id,name", "name,id"))
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_csv_multiline(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'id,note\n1,"two\nlines"\n2,one\n')
    df = files.read_csv(spark, path, multiline=True)
    assert df.schema.simpleString() == "struct<id:bigint,note:string>"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "two\nlines"), (2, "one")]


def test_jsonl_sample(spark, tmp_path):
    df = files.read_jsonl(spark, write(tmp_path / "sample.jsonl", JSONL))
    assert df.schema.simpleString() == SCHEMA
    assert df.count() == 5


def test_jsonl_types(spark, tmp_path):
    text = '{"z":1,"a":{"c":[1,2.5],"b":null}}\n{"z":2.5,"a":{"d":"x"},"n":null}\n'
    df = files.read_jsonl(spark, write(tmp_path / "t.jsonl", text))
    assert df.schema.simpleString() == "struct<z:double,a:struct<c:array<double>,b:string,d:string>,n:string>"


def test_jsonl_empty_has_no_fields(spark, tmp_path):
    df = files.read_jsonl(spark, write(tmp_path / "e.jsonl", ""))
    assert df.columns == [] and df.count() == 0


def test_jsonl_malformed_line_fails(spark, tmp_path):
    path = write(tmp_path / "bad.jsonl", '{"id":1}\nnot valid json\n{"id":3}\n')
    with pytest.raises(InvalidRequest):
        files.read_jsonl(spark, path)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.read_jsonl(spark, path, files.T.StructType.fromDDL("id bigint")).collect()


def test_jsonl_type_conflict_fails(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", '{"id":1}\n{"id":"not_a_number"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.read_jsonl(spark, path, files.T.StructType.fromDDL("id bigint")).collect()


@pytest.mark.parametrize("late", ['{"t":5}', '{"t":true}', '{"t":"x","o":{"u":[1]}}', '{"t":["x"]}', '{"n":"1"}', '{"n":1.5}', '{"n":true}', '{"f":"1.5"}', '{"b":1}', '{"b":"true"}', '{"o":[]}'])
def test_jsonl_late_conflict_fails(spark, tmp_path, late):
    first = '{"t":"x","n":1,"f":1.5,"b":true,"o":{"u":["a",null]}}\n'
    path = write(tmp_path / "c.jsonl", first * 30_000 + late + "\n")
    early = "t string, n bigint, f double, b boolean, o struct<u: array<string>>"
    df = files.read_jsonl(spark, path, files.T.StructType.fromDDL(early))
    assert df.limit(1).first()["o"]["u"] == ["a", None]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed|JSON Lines field"):
        df.write.format("noop").mode("overwrite").save()


def test_jsonl_values_that_fit(spark, tmp_path):
    path = write(tmp_path / "ok.jsonl", '{"t":"x","f":1.5}\n{"t":null,"f":2}\n{"f":null,"extra":1}\n\n')
    df = files.read_jsonl(spark, path, files.T.StructType.fromDDL("t string, f double"))
    assert [tuple(r) for r in df.collect()] == [("x", 1.5), (None, 2.0), (None, None)]


def test_late_keys_and_wider_types_are_found(spark, tmp_path):
    pad = "x" * 2_000
    (tmp_path / "jsonl").mkdir()
    (tmp_path / "csv").mkdir()
    lines = "".join(json.dumps({"id": i, "pad": pad}) + "\n" for i in range(1500))
    write(tmp_path / "jsonl" / "a.jsonl", lines)
    write(tmp_path / "jsonl" / "b.jsonl", '{"id":1}\n{"id":2.5,"late":{"k":"v"}}\n')
    df = files.read_jsonl(spark, str(tmp_path / "jsonl"))
    assert dict(df.dtypes) == {"id": "double", "pad": "string", "late": "struct<k:string>"}
    assert df.where("late is not null").select("late.k").collect()[0][0] == "v"
    write(tmp_path / "csv" / "a.csv", "a,b\n" + "".join(f"{i},{pad}\n" for i in range(1500)))
    write(tmp_path / "csv" / "b.csv", "a,b\n1.5,z\n")
    df = files.read_csv(spark, str(tmp_path / "csv"))
    assert df.dtypes == [("a", "double"), ("b", "string")] and df.where("a = 1.5").count() == 1
    spark.range(3).write.parquet(str(tmp_path / "p" / "one"))
    spark.range(3).selectExpr("id", "'x' AS added").write.parquet(str(tmp_path / "p" / "two"))
    assert files.read_parquet(spark, [str(tmp_path / "p" / "one"), str(tmp_path / "p" / "two")]).columns == ["id", "added"]


def test_one_bad_line_fails_the_inference(spark, tmp_path):
    for bad in ("{", "[1]", '{"a":{"b":1}}'):
        path = write(tmp_path / f"{len(bad)}.jsonl", '{"a":1}\n' * 50 + bad + "\n")
        with pytest.raises(InvalidRequest):
            files.read_jsonl(spark, path)


def test_sql_is_confined_to_its_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(5).createOrReplaceTempView("foreign_view")
    sqltext.register_tables(spark, str(tmp_path / "{name}.parquet"), ["t"])
    for text in (
        f"SELECT * FROM parquet.`{tmp_path}/t.parquet`",
        "SELECT * FROM foreign_view",
        "SELECT * FROM t WHERE id IN (SELECT id FROM foreign_view)",
        "WITH a AS (SELECT * FROM foreign_view) SELECT * FROM a",
        "SELECT reflect('java.lang.System', 'currentTimeMillis')",
        "SELECT `java_method`/**/('java.lang.System', 'currentTimeMillis') FROM t",
    ):
        with pytest.raises(SqlError):
            sqltext.sql_read(spark, text, tables=["t"])
    assert sqltext.sql_read(spark, "WITH a AS (SELECT * FROM T) SELECT x.id FROM a x JOIN t USING (id)", tables=["t"]).count() == 3


@pytest.mark.parametrize("own_session", [False, True])
def test_long_sql_is_confined_to_its_end(spark, tmp_path, own_session):
    spark = spark.newSession() if own_session else spark
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    sqltext.register_tables(spark, str(tmp_path / "{name}.parquet"), ["t"])
    call, before = "reflect('java.lang.System', 'currentTimeMillis')", spark.conf.get("spark.sql.debug.maxToStringFields")
    numbers = ", ".join(map(str, range(30)))
    columns = ", ".join(f"{i} AS c{i}" for i in range(30))
    names = ", ".join(f"a{i} AS (SELECT * FROM t)" for i in range(30))
    for text in (
        f"SELECT {columns}, {call} AS x FROM t",
        f"SELECT ({numbers}, {call}) AS x FROM t",
        f"SELECT * FROM t WHERE id IN ({numbers}, {call})",
        f"SELECT greatest({numbers}, {call}) AS x FROM t",
        f"SELECT id FROM t GROUP BY id, {numbers}, {call}",
        f"SELECT {columns}, (SELECT max(id) FROM foreign_view) AS x FROM t",
        f"SELECT ({numbers}, (SELECT max(id) FROM foreign_view)) AS x FROM t",
        f"WITH {names} SELECT * FROM a29 JOIN foreign_view USING (id)",
    ):
        with pytest.raises(SqlError, match="Java code|not a table"):
            sqltext.sql_read(spark, text, tables=["t"])
    assert sqltext.sql_read(spark, f"WITH {names} SELECT {columns} FROM a29 JOIN a0 USING (id)", tables=["t"]).count() == 3
    assert spark.conf.get("spark.sql.debug.maxToStringFields") == before


def test_sql_is_confined_however_a_name_is_spelled(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(3).selectExpr("id AS secret").createOrReplaceTempView("secretview")
    spark.sql("SELECT 1 AS a").createOrReplaceGlobalTempView("shared")
    spark.range(2).createOrReplaceTempView("own")
    spark.udf.register("mine", lambda: "x")
    tables = {"own": spark.read.parquet(str(tmp_path / "t.parquet"))}
    for text in (
        "SELECT * FROM secretview",
        "SELECT * FROM IDENTIFIER('secretview')",
        f"SELECT * FROM IDENTIFIER('parquet.`{tmp_path}/t.parquet`')",
        f"SELECT * FROM parquet.`{tmp_path}/t.parquet`",
        "SELECT * FROM global_temp.shared",
        "SELECT * FROM own JOIN global_temp.shared ON id = a",
        "SELECT (SELECT max(a) FROM global_temp.shared) AS x FROM own",
        "SELECT * FROM own WHERE EXISTS (SELECT 1 FROM own o WHERE o.id IN (SELECT a FROM global_temp.shared))",
        "SELECT * FROM (WITH secretview AS (SELECT 1 a) SELECT * FROM secretview) x, secretview",
        "SELECT * FROM own, LATERAL (SELECT max(secret) FROM secretview)",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'currentTimeMillis') FROM own",
        "SELECT try_reflect('java.lang.System', 'currentTimeMillis') FROM own",
        "SELECT mine() FROM own",
    ):
        with pytest.raises(SqlError):
            sqltext.sql_read(spark, text, tables=tables)
    for text in ("SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'currentTimeMillis')"):
        with pytest.raises(SqlError, match="Java code"):
            sqltext.sql_read(spark, text)
    read = lambda text: sqltext.sql_read(spark, text, tables=tables).collect()
    assert read("SELECT 'please reflect(on) this' AS x, 'secretview' AS y") == [("please reflect(on) this", "secretview")]
    assert len(read("SELECT * FROM IDENTIFIER('own') JOIN (VALUES (1), (2)) v(id) USING (id)")) == 2
    recursive = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r, range(2), own"
    assert len(read(recursive)) == 30
    # The connection's tables aren't the session's: neither sees the other's view of the same name.
    assert spark.table("own").count() == 2 and read("SELECT count(*) FROM own")[0][0] == 3
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true" and sqltext.sql_read(spark, "SELECT mine() AS x FROM secretview").count() == 3
    joined = spark.table("own").join(sqltext.sql_read(spark, "SELECT id FROM own", tables=tables), "id")
    assert joined.count() == 2


def test_mixed_folder(spark, tmp_path):
    names = "category string, id bigint, prompt string"
    rows = [(f"c{i}", i, f"p{i}") for i in (11, 12, 13)]
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "p"))
    write(tmp_path / "b.CSV", "id,category,prompt\n1,c1,p1\n2,c2,p2\n3,c3,p3\n")
    write(tmp_path / "c.ndjson", "".join(json.dumps({"id": i, "category": f"c{i}", "prompt": f"p{i}"}) + "\n" for i in (21, 22, 23)))
    (tmp_path / "p" / "_SUCCESS").unlink()
    df = files.read_mixed(spark, str(tmp_path))
    got = {(r["format"], r["id"], r["category"]) for r in df.collect()}
    want = {("parquet", 11), ("parquet", 12), ("parquet", 13), ("csv", 1), ("csv", 2), ("csv", 3), ("jsonl", 21), ("jsonl", 22), ("jsonl", 23)}
    assert got == {(f, i, f"c{i}") for f, i in want}
    write(tmp_path / "d.json", "{}")
    with pytest.raises(InvalidRequest):
        files.read_mixed(spark, str(tmp_path))


def test_round_trip_with_null(spark, tmp_path):
    rows = [(1, "alice", 95.5), (2, "bob", 87.0), (3, "charlie", 92.3), (4, "diana", None), (5, "eve", 88.1)]
    df = spark.createDataFrame(rows, "id int, name string, score double")
    df.write.parquet(str(tmp_path / "f.parquet"))
    back = files.read_object(spark, str(tmp_path / "f.parquet")).orderBy("id").collect()
    assert [tuple(r) for r in back] == rows


# -- SQL text ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    [
        "DELETE FROM t", "DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE x (a int)", "TRUNCATE TABLE t",
        "UPDATE t SET a = 1", "SET spark.sql.ansi.enabled = false", "SELECT 1) q; DROP TABLE t",
    ],
)
def test_only_reads(spark, text):
    spark.range(3).createOrReplaceTempView("t")
    with pytest.raises(SqlError):
        sqltext.sql_read(spark, text)


def test_sql_forms(spark):
    spark.range(5).createOrReplaceTempView("t")
    assert [r[0] for r in sqltext.sql_read(spark, "SELECT id FROM t ORDER BY id DESC -- note").collect()] == [4, 3, 2, 1, 0]
    assert sqltext.sql_read(spark, "WITH a AS (SELECT 1 x) SELECT x FROM a;").collect()[0][0] == 1
    assert sqltext.sql_read(spark, "SELECT id FROM t WHERE id = :k", {"k": 3}).count() == 1
    assert sqltext.sql_read(spark, "SELECT id FROM t WHERE id > ? AND id < ?", [1, 4]).count() == 2


def test_describe_runs_nothing(spark):
    df = sqltext.describe_query(sqltext.sql_read(spark, "SELECT 1 AS a, 'x' AS b, CAST(NULL AS DATE) AS c"))
    assert [tuple(r) for r in df.orderBy("position").collect()] == [
        (0, "a", "int", False), (1, "b", "string", False), (2, "c", "date", True),
    ]


# -- SQLite ------------------------------------------------------------------------------------

PROMPTS = ["factuality"] * 2 + ["reasoning"] * 2 + ["safety"] * 2 + ["instruction_following"] * 2 + ["multilingual", "creativity"]


@pytest.fixture
def prompts(tmp_path):
    path = str(tmp_path / "prompts.db")
    connection = sqlite3.connect(path)
    connection.execute("CREATE TABLE prompts (id INTEGER PRIMARY KEY, category TEXT, ok BOOLEAN, w REAL, raw BLOB, n NUMERIC)")
    rows = [(i, c, i % 2, i / 2, bytes([i]), None if i == 3 else i) for i, c in enumerate(PROMPTS, 1)]
    connection.executemany("INSERT INTO prompts VALUES (?, ?, ?, ?, ?, ?)", rows)
    connection.commit()
    connection.close()
    return path


def test_sqlite_read(spark, prompts):
    df = sqlite.read_sqlite(spark, f"sqlite://{prompts}", "SELECT * FROM prompts")
    assert df.schema.simpleString() == "struct<id:bigint,category:string,ok:boolean,w:double,raw:binary,n:string>"
    rows = df.orderBy("id").collect()
    assert [r["category"] for r in rows] == PROMPTS
    assert rows[0]["ok"] is True and rows[1]["ok"] is False and rows[2]["n"] is None and rows[3]["n"] == "4"
    assert bytes(rows[4]["raw"]) == b"\x05"


def test_sqlite_ranges_lose_nothing(spark, prompts):
    text = "SELECT id, CASE WHEN id = 7 THEN NULL ELSE id * 10 END AS k FROM prompts"
    df = sqlite.read_sqlite(spark, prompts, text, "k", 4)
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r["id"] for r in df.collect()) == list(range(1, 11))
    assert df.schema["k"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("text", ["DELETE FROM prompts", "INSERT INTO prompts VALUES (1)", "SELECT 1; DROP TABLE prompts"])
def test_sqlite_only_reads(spark, prompts, text):
    with pytest.raises(Exception, match="syntax error|one statement|only execute"):
        sqlite.read_sqlite(spark, prompts, text).collect()
    connection = sqlite3.connect(prompts)
    assert connection.execute("SELECT count(*) FROM prompts").fetchone() == (10,)
    connection.close()


def test_sqlite_path():
    assert sqlite.local_path("sqlite:///data/x.db") == "/data/x.db"
    assert sqlite.local_path("/data/x.db") == "/data/x.db"
    with pytest.raises(SourceUnavailable):
        sqlite.local_path("s3a://bucket/x.db")


# -- JDBC (options only: no database is started) -------------------------------------------------


def test_jdbc_target():
    url, login = jdbc.jdbc_target("postgresql://user:p%40ss@host:5432/db?sslmode=require")
    assert url == "jdbc:postgresql://host:5432/db?sslmode=require"
    assert login == {"user": "user", "password": "p@ss"}
    with pytest.raises(SourceUnavailable):
        jdbc.jdbc_target("mysql://host/db")


def test_jdbc_options():
    options = jdbc.jdbc_options("postgresql://h/db", "SELECT 1 -- x;", "id", (0, 100), 8)
    assert options["dbtable"] == "(\nSELECT 1 -- x\n) q"
    assert "READ ONLY" in options["sessionInitStatement"]
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", "0", "100", "8")
    assert "sessionInitStatement" not in jdbc.jdbc_options("jdbc:other:x", "SELECT 1")
    with pytest.raises(InvalidRequest):
        jdbc.jdbc_options("postgresql://h/db", "SELECT 1", "id")


def test_decimals_as_text(spark):
    df = jdbc.decimals_as_text(spark.sql("SELECT 12345.6789 AS n, 1 AS i, CAST(0.0000001 AS DECIMAL(20, 10)) AS tiny"))
    assert tuple(df.first()) == ("12345.6789", 1, "0.0000001000")


# -- export ------------------------------------------------------------------------------------


def test_export_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    export.export_batches(spark.range(100).coalesce(1), path, 30)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in per_file) == [10, 30, 30, 30]


def test_iter_batches(spark):
    for parts in (1, 7):
        df = spark.range(0, 100, 1, parts).withColumn("t", F.array(F.col("id").cast("string"))).orderBy(F.col("id").desc())
        batches = list(export.iter_batches(df, 30))
        assert [b.num_rows for b in batches] == [30, 30, 30, 10]
        assert [r for b in batches for r in b.column(0).to_pylist()] == list(range(99, -1, -1))
        assert batches[0].column(1).to_pylist()[0] == ["99"]
    assert [b.num_rows for b in export.iter_batches(spark.range(25_000), 9_999)] == [9_999, 9_999, 5_002]
    assert list(export.iter_batches(spark.range(0), 5)) == []
    with pytest.raises(ConfigError):
        next(export.iter_batches(spark.range(1), 0))


def test_empty_folder(spark, tmp_path):
    with pytest.raises(NoData):
        files.read_mixed(spark, str(tmp_path))
