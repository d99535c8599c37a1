"""Type names of each kind of source and the Spark types their values are read as."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source type name -> Spark type. Every other name reads as string.
SQL_SERVER_TYPES = {
    "BOOL": "boolean",
    "INT2": "smallint",
    "SMALLINT": "smallint",
    "SMALLSERIAL": "smallint",
    "INT4": "int",
    "INT": "int",
    "INTEGER": "int",
    "SERIAL": "int",
    "INT8": "bigint",
    "BIGINT": "bigint",
    "BIGSERIAL": "bigint",
    "FLOAT4": "float",
    "REAL": "float",
    "FLOAT8": "double",
    "DOUBLE PRECISION": "double",
    "BYTEA": "binary",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMPTZ": "timestamp",
    "DATE": "date",
    "TIME": "time(6)",
    "NUMERIC": "string",
    "UUID": "string",
    "JSON": "string",
    "JSONB": "string",
}
SQLITE_TYPES = {
    "BOOLEAN": "boolean",
    "INTEGER": "bigint",
    "REAL": "double",
    "BLOB": "binary",
}
SEARCH_TYPES = {
    "boolean": "boolean",
    "byte": "tinyint",
    "short": "smallint",
    "integer": "int",
    "long": "bigint",
    "half_float": "float",
    "float": "float",
    "double": "double",
    "scaled_float": "double",
    "date": "timestamp",
    "date_nanos": "timestamp",
}
VECTOR_TYPES = {
    "Bool": "boolean",
    "Int8": "tinyint",
    "Int16": "smallint",
    "Int32": "int",
    "Int64": "bigint",
    "Float": "float",
    "Double": "double",
    "VarChar": "string",
    "Json": "string",
    "Geometry": "string",
    "Timestamptz": "string",
}
GRAPH_TYPES = {
    "Boolean": "boolean",
    "Integer": "bigint",
    "Float": "double",
    "String": "string",
    "Bytes": "binary",
    "Date": "date",
    "DateTime": "timestamp",
    "DateTimeZoneId": "timestamp",
    "LocalDateTime": "timestamp_ntz",
}
TYPE_MAPS = {
    "postgres": SQL_SERVER_TYPES,
    "sqlite": SQLITE_TYPES,
    "elasticsearch": SEARCH_TYPES,
    "milvus": VECTOR_TYPES,
    "neo4j": GRAPH_TYPES,
}
# Document and graph timestamps are kept to the millisecond, database ones to the microsecond.
MILLISECOND_SOURCES = frozenset({"elasticsearch", "neo4j"})


def spark_type(source: str, type_name: str) -> str:
    """Spark type (DDL text) of one source type name; unknown names are strings."""
    return TYPE_MAPS[source].get(type_name, "string")


def spark_type_column(source: str, type_name: Column) -> Column:
    """The same lookup for a column of type names, as one literal map (no join)."""
    entries = [F.lit(part) for pair in TYPE_MAPS[source].items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), type_name), F.lit("string"))


def cast_declared(column: Column, source: str, type_name: str) -> Column:
    """A source value as the type its declared name stands for."""
    target = spark_type(source, type_name)
    cast = column.cast(target)
    if target.startswith("timestamp") and source in MILLISECOND_SOURCES:
        # date_trunc answers with a zoned timestamp, so go back to the asked type
        cast = F.date_trunc("MILLISECOND", cast).cast(target)
    return cast


def apply_type_map(df: DataFrame, source: str, declared: Mapping[str, str]) -> DataFrame:
    """Project ``df`` to the declared columns, each read as its declared source type."""
    return df.select(*[cast_declared(F.col(f"`{c}`"), source, name).alias(c) for c, name in declared.items()])


def epoch_micros(column: Column) -> Column:
    """Timestamp without zone -> microseconds since 1970, negative before; no time zone is involved."""
    since = column.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def epoch_micros_utc(column: Column) -> Column:
    """Instant -> microseconds since 1970 UTC."""
    return F.unix_micros(column.cast("timestamp"))


def epoch_days(column: Column) -> Column:
    """Date -> days since 1970-01-01, negative before."""
    return F.unix_date(column.cast("date"))


def midnight_micros(column: Column) -> Column:
    """Time of day, as a time or as ``HH:mm:ss.ffffff`` text -> microseconds since midnight."""
    return epoch_micros(F.concat(F.lit("1970-01-01 "), column.cast("string")))


def stringify(column: Column, data_type: T.DataType) -> Column:
    """Decimal, UUID text and JSON values as text; NULL stays NULL, JSON nulls are kept."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")
