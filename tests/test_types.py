from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weirgate.functions import extract, types


@pytest.mark.parametrize(
    ("source", "name", "expected"),
    [
        ("postgres", "BOOL", "boolean"), ("postgres", "SMALLSERIAL", "smallint"), ("postgres", "SERIAL", "int"),
        ("postgres", "BIGSERIAL", "bigint"), ("postgres", "REAL", "float"), ("postgres", "DOUBLE PRECISION", "double"),
        ("postgres", "BYTEA", "binary"), ("postgres", "TIMESTAMP", "timestamp_ntz"), ("postgres", "TIMESTAMPTZ", "timestamp"),
        ("postgres", "DATE", "date"), ("postgres", "TIME", "time(6)"), ("postgres", "NUMERIC", "string"),
        ("postgres", "UUID", "string"), ("postgres", "JSONB", "string"), ("postgres", "INTERVAL", "string"),
        ("sqlite", "BOOLEAN", "boolean"), ("sqlite", "INTEGER", "bigint"), ("sqlite", "REAL", "double"),
        ("sqlite", "BLOB", "binary"), ("sqlite", "TEXT", "string"), ("sqlite", "BIGINT", "string"),
        ("elasticsearch", "byte", "tinyint"), ("elasticsearch", "short", "smallint"), ("elasticsearch", "integer", "int"),
        ("elasticsearch", "long", "bigint"), ("elasticsearch", "half_float", "float"), ("elasticsearch", "scaled_float", "double"),
        ("elasticsearch", "date_nanos", "timestamp"), ("elasticsearch", "geo_point", "string"),
        ("milvus", "Int8", "tinyint"), ("milvus", "Float", "float"), ("milvus", "Json", "string"), ("milvus", "Other", "string"),
        ("neo4j", "Integer", "bigint"), ("neo4j", "Bytes", "binary"), ("neo4j", "DateTimeZoneId", "timestamp"),
        ("neo4j", "LocalDateTime", "timestamp_ntz"), ("neo4j", "Node", "string"), ("neo4j", "Null", "string"),
    ],
)
def test_type_names(spark, source, name, expected):
    assert types.spark_type(source, name) == expected
    assert spark.range(1).select(types.spark_type_column(source, F.lit(name))).first()[0] == expected


def test_literal_row(spark):
    """One row of every database type; instants are compared as epoch values."""
    raw = spark.sql(
        """SELECT '2026-08-17 12:34:56.123456' ts, CAST(NULL AS STRING) ts_null, '1970-01-01 00:00:00' ts_epoch,
                  '2026-08-17 12:34:56.123456Z' tstz, '2026-08-17 20:34:56.123456+08:00' tstz_asia,
                  '2026-08-17' d, '12:34:56.123456' t, '00:00:00' t_midnight, '23:59:59.999999' t_end,
                  '550e8400-e29b-41d4-a716-446655440000' u, '{"k":"v"}' j, 12345.6789 n"""
    )
    names = ["TIMESTAMP"] * 3 + ["TIMESTAMPTZ"] * 2 + ["DATE"] + ["TIME"] * 3 + ["UUID", "JSON", "NUMERIC"]
    row = types.apply_type_map(raw, "postgres", dict(zip(raw.columns, names)))
    got = row.first()
    assert got["ts"] == dt.datetime(2026, 8, 17, 12, 34, 56, 123456)
    assert got["ts_null"] is None and got["ts_epoch"] == dt.datetime(1970, 1, 1)
    same = row.select(F.unix_micros("tstz") == F.unix_micros("tstz_asia"), F.unix_micros("tstz")).first()
    assert tuple(same) == (True, 1786970096123456)
    assert got["d"] == dt.date(2026, 8, 17)
    assert (got["t"], got["t_midnight"]) == (dt.time(12, 34, 56, 123456), dt.time(0))
    assert got["t_end"] == dt.time(23, 59, 59, 999999)
    assert (got["u"], got["j"], got["n"]) == ("550e8400-e29b-41d4-a716-446655440000", '{"k":"v"}', "12345.6789")


def test_epochs(spark):
    df = spark.sql(
        """SELECT TIMESTAMP_NTZ'2025-06-15 10:30:00.123456' a, TIMESTAMP_NTZ'1969-12-31 23:59:59' b,
                  DATE'2025-06-15' c, DATE'1969-12-31' d, '13:45:30.123456' e, TIMESTAMP'2025-06-15 10:30:00.123456Z' f"""
    )
    got = df.select(
        types.epoch_micros(F.col("a")), types.epoch_micros(F.col("b")), types.epoch_days(F.col("c")),
        types.epoch_days(F.col("d")), types.midnight_micros(F.col("e")), types.epoch_micros_utc(F.col("f")),
    )
    assert tuple(got.first()) == (1749983400123456, -1000000, 20254, -1, 49530123456, 1749983400123456)


def test_epochs_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2025-03-09 02:30:00' a").select(types.epoch_micros(F.col("a")))
        assert df.first()[0] == 1741487400000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


DOC = (
    '{"user":{"name":"Alice","age":30},"whole":12,"point":12.0,"text":"12","none":null,"flag":true,'
    '"big":9223372036854775808,"obj":{"nested":true},"list":[1,2.50],"a.b":1,"n":300,"m":-129}'
)


@pytest.fixture(scope="module")
def doc(spark):
    return extract.parsed(spark.createDataFrame([(DOC,)], "doc string"), "doc")


def at(path):
    return extract.value_at(F.col(extract.PARSED), path)


@pytest.mark.parametrize(
    ("read", "path", "expected"),
    [
        (extract.as_int, "whole", 12), (extract.as_int, "point", None), (extract.as_int, "text", None),
        (extract.as_int, "big", None), (extract.as_int, "none", None), (extract.as_int, "missing.deeper", None),
        (extract.as_float, "whole", 12.0), (extract.as_float, "point", 12.0), (extract.as_float, "text", None),
        (extract.as_float, "big", 9223372036854775808.0), (extract.as_float, "flag", None),
        (extract.as_bool, "flag", True), (extract.as_bool, "whole", None), (extract.as_bool, "text", None),
    ],
)
def test_kinds(doc, read, path, expected):
    assert doc.select(read(at(path))).first()[0] == expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("user.name", "Alice"), ("user.age", "30"), ("whole", "12"), ("point", "12.0"), ("text", "12"), ("none", "null"),
        ("flag", "true"), ("big", "9223372036854775808"), ("obj", '{"nested":true}'), ("list", "[1,2.5]"),
        ("missing", None), ("user.missing", None), ("whole.x", None),
    ],
)
def test_text(doc, path, expected):
    assert doc.select(extract.as_text(at(path), F.col("doc"), path)).first()[0] == expected


def test_wrap(doc):
    got = doc.select(
        extract.wrap_int(extract.as_int(at("n")), "tinyint"),
        extract.wrap_int(extract.as_int(at("m")), "tinyint"),
        extract.wrap_int(F.lit(70000), "smallint"),
        extract.wrap_int(F.lit(2**31), "int"),
        extract.wrap_int(F.lit(None), "int"),
    ).first()
    assert tuple(got) == (44, 127, 4464, -(2**31), None)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("1700000000000", 1700000000000), ('"2023-11-14T22:13:20.000Z"', 1700000000000),
        ('"2023-11-14T22:13:20"', 1700000000000), ('"2023-11-14T22:13:20.123987"', 1700000000123),
        ('"2023-11-15T00:13:20+02:00"', 1700000000000), ('"2023-11-14t22:13:20z"', 1700000000000),
        ('"1969-12-31T23:59:59.9995Z"', -1), ('"2023-11-14"', None), ('"12345"', None), ('"nonsense"', None),
        ('"2023-13-14T22:13:20Z"', None), ("1.5", None), ("true", None), ("null", None),
    ],
)
def test_instants(spark, value, expected):
    df = extract.parsed(spark.createDataFrame([(f'{{"t":{value}}}',)], "doc string"), "doc")
    assert df.select(F.unix_millis(extract.as_instant(at("t")))).first()[0] == expected


def test_nested_text_keeps_nulls(spark):
    df = spark.sql("SELECT named_struct('a', CAST(NULL AS INT), 'b', 1) s")
    assert df.select(types.stringify(F.col("s"), df.schema["s"].dataType)).first()[0] == '{"a":null,"b":1}'


def test_values_at_the_edges(spark):
    rows = [('{"t":9223372036854775807,"a\'b":{"x":[1]},"k":1,"k":2}',), ('{"t":1}',)]
    df = spark.createDataFrame(rows, "doc string")
    got = extract.extract_typed(df, "doc", [(["t"], "timestamp"), (["a'b"], "string"), (["k"], "bigint")]).collect()
    assert [r[0] and r[0].year for r in got] == [None, 1970]
    assert got[0][1] == '{"x":[1]}' and got[0][2] == 2
