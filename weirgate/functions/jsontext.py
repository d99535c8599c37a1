"""Graph values as JSON text: nodes, edges, paths, points, collections and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_NULLS = {"ignoreNullFields": "false"}


def _fraction(column: Column) -> Column:
    """Fraction of a second with 0, 3 or 6 digits, as many as the value needs."""
    six = F.date_format(column, "SSSSSS")
    return (
        F.when(six == "000000", F.lit(""))
        .when(six.endswith("000"), F.concat(F.lit("."), F.substring(six, 1, 3)))
        .otherwise(F.concat(F.lit("."), six))
    )


def temporal_text(column: Column, data_type: T.DataType) -> Column:
    """Date ``2023-11-14``, instant ``2023-11-14T22:13:20+00:00``, local ``2023-11-14 22:13:20``.

    Durations are ISO 8601; an instant is written with the session time zone's offset.
    """
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, T.TimestampType):
        return F.concat(
            F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), _fraction(column), F.date_format(column, "xxx")
        )
    if isinstance(data_type, T.TimestampNTZType):
        return F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), _fraction(column))
    if isinstance(data_type, T.DayTimeIntervalType):
        seconds = column.cast("interval second").cast("decimal(18,6)")
        plain = F.rtrim(F.rtrim(seconds.cast("string"), F.lit("0")), F.lit("."))
        return F.concat(F.lit("PT"), plain, F.lit("S"))
    return column.cast("string")


_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.TimeType)


def json_ready(column: Column, data_type: T.DataType) -> Column:
    """The value with every time as text, bytes as base64 and object keys in name order, at any depth."""
    if isinstance(data_type, _TEMPORAL):
        return temporal_text(column, data_type)
    if isinstance(data_type, T.BinaryType):
        return F.base64(column)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: json_ready(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        ready = F.transform_values(column, lambda _, value: json_ready(value, data_type.valueType))
        return F.map_from_entries(F.array_sort(F.map_entries(ready), _by_key))
    if isinstance(data_type, T.StructType):
        fields = sorted(data_type.fields, key=lambda f: f.name)
        built = F.struct(*[json_ready(column.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), built)
    return column


def _by_key(left: Column, right: Column) -> Column:
    lk, rk = left.getField("key"), right.getField("key")
    return F.when(lk < rk, -1).when(lk > rk, 1).otherwise(0)


def collection_to_json(column: Column, data_type: T.DataType) -> Column:
    """A list, map or struct value as JSON text; nulls inside are kept."""
    return F.to_json(json_ready(column, data_type), KEEP_NULLS)


def node_value(node_id: Column, labels: Column, properties: Column, properties_type: T.DataType) -> Column:
    return F.struct(
        node_id.alias("id"), labels.alias("labels"), json_ready(properties, properties_type).alias("properties")
    )


def node_to_json(node_id: Column, labels: Column, properties: Column, properties_type: T.DataType) -> Column:
    """``{"id":..,"labels":[..],"properties":{..}}``."""
    return F.to_json(node_value(node_id, labels, properties, properties_type), KEEP_NULLS)


def unbound_edge_value(edge_id: Column, typ: Column, properties: Column, properties_type: T.DataType) -> Column:
    return F.struct(
        edge_id.alias("id"), json_ready(properties, properties_type).alias("properties"), typ.alias("typ")
    )


def edge_to_json(
    edge_id: Column,
    typ: Column,
    properties: Column,
    properties_type: T.DataType,
    ends: tuple[Column, Column] | None = None,
) -> Column:
    """An edge with its two node ids, or the unbound form when ``ends`` is not given."""
    if ends is None:
        return F.to_json(unbound_edge_value(edge_id, typ, properties, properties_type), KEEP_NULLS)
    start, end = ends
    bound = F.struct(
        end.alias("end_node_id"),
        edge_id.alias("id"),
        json_ready(properties, properties_type).alias("properties"),
        start.alias("start_node_id"),
        typ.alias("typ"),
    )
    return F.to_json(bound, KEEP_NULLS)


def path_to_json(nodes: Sequence[Column], edges: Sequence[Column]) -> Column:
    """``{"nodes":[..],"relationships":[..]}`` from node and unbound edge values of one type each."""
    whole = F.struct(F.array(*nodes).alias("nodes"), F.array(*edges).alias("relationships"))
    return F.to_json(whole, KEEP_NULLS)


def point_to_json(srid: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    """``{"srid":..,"x":..,"y":..}`` with ``z`` for points in space."""
    parts = [srid.alias("srid"), x.alias("x"), y.alias("y")]
    if z is not None:
        parts.append(z.alias("z"))
    return F.to_json(F.struct(*parts), KEEP_NULLS)
