"""Every registered query against its SQL on the same Parquet files."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from weirgate.plans.tables import NAMES

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "SMALLINT": "smallint",
    "TINYINT": "tinyint",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "FLOAT": "float",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
    "FLOAT[]": "array<float>",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(float(value))
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    expected_kinds = {r[0]: TYPES[str(r[1])] for r in duck.execute("DESCRIBE " + ORACLE[name]).fetchall()}
    assert kinds == expected_kinds
    assert rows(got.toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
