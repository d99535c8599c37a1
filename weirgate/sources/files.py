"""Object files: Parquet, CSV with a header, JSON Lines."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest, NoData

# Format name -> accepted hints and file endings (lower case). `.json` is not one.
FORMATS = {
    "parquet": ("parquet",),
    "csv": ("csv",),
    "jsonl": ("jsonl", "ndjson", "jsonlines"),
}

# RFC 4180 quoting: a quote inside a quoted value is doubled, the backslash is an ordinary character.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def detect_format(path: str, hint: str | None = None) -> str:
    """The format hint, if there is one, decides over the file ending."""
    if hint is not None:
        for name, endings in FORMATS.items():
            if hint.lower() in endings:
                return name
        raise InvalidRequest(f"unknown format hint '{hint}'")
    lowered = path.lower()
    for name, endings in FORMATS.items():
        if lowered.endswith(tuple(f".{e}" for e in endings)):
            return name
    raise InvalidRequest(f"no known file ending in '{path}'; give the connection a format")


def format_column(path: Column) -> Column:
    """``detect_format`` by ending for a column of paths; NULL where no format fits."""
    lowered = F.lower(path)
    found = F.lit(None).cast("string")
    for name, endings in FORMATS.items():
        fits = reduce(lambda a, b: a | b, [F.endswith(lowered, F.lit(f".{e}")) for e in endings])
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """One row per file with its size and detected format; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return listing.select("path", "length", format_column(F.col("path")).alias("format"))


def names_at(spark: SparkSession, location: str, pattern: str) -> list[str]:
    """The sorted names for which ``location``, which holds ``{name}``, leads to a file or folder; ``*`` in the pattern is any text."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location.replace("{name}", pattern))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    before, _, after = location.partition("{name}")
    before, after, depth = before.rpartition("/")[2], after.partition("/")[0], after.count("/")
    names = []
    for status in found:
        own = status.getPath()
        for _ in range(depth):
            own = own.getParent()
        names.append(own.getName()[len(before) : len(own.getName()) - len(after)])
    return sorted(n for n in names if not n.startswith(("_", ".")))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns that any of the files has; filters and column lists reach the scan."""
    return spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))


# -- CSV --------------------------------------------------------------------------------------

# What a cell must look like to count as a type; empty cells do not vote.
CSV_CELL = {
    "boolean": r"(?i)^(true|false)$",
    "bigint": r"^-?\d+$",
    "double": r"^-?((\d*\.\d+|\d+\.\d*)([eE][-+]?\d+)?|\d+([eE][-+]?\d+))$",
    "date": r"^\d{4}-\d\d-\d\d$",
    "timestamp_ntz": r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,9})?$",
    "timestamp": r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,9})?([Zz]|[+-]\d\d:?\d\d)$",
}


def _csv_type(seen: frozenset[str]) -> T.DataType:
    if seen <= {"boolean"} and seen:
        return T.BooleanType()
    if seen == {"bigint"}:
        return T.LongType()
    if seen and seen <= {"bigint", "double"}:
        return T.DoubleType()
    if seen == {"date"}:
        return T.DateType()
    if seen and seen <= {"date", "timestamp_ntz"}:
        return T.TimestampNTZType()
    if seen and seen <= {"date", "timestamp_ntz", "timestamp"}:
        return T.TimestampType()
    return T.StringType()


def infer_csv_schema(
    spark: SparkSession, path: str, multiline: bool = False, options: dict[str, str] | None = None
) -> T.StructType:
    """Column names from the first header, types from all cells of all files in one pass; all nullable.

    The driver gets the header and the set of kinds of each column.
    """
    header = spark.read.options(**(options or {})).text(path).first()
    if header is None:
        return T.StructType([])
    names = next(csv.reader([header["value"]]), [])
    if not names:
        return T.StructType([])
    reader = spark.read.options(**(options or {})).options(header="true", quote='"', escape='"')
    cells = reader.option("multiLine", str(multiline).lower()).schema(_text_cells(len(names))).csv(path)
    kinds = [F.collect_set(_cell_kind(F.col(f"c{i}"))).alias(f"k{i}") for i in range(len(names))]
    votes = cells.agg(*kinds).first()
    return T.StructType(
        [T.StructField(name, _csv_type(frozenset(votes[f"k{i}"]))) for i, name in enumerate(names)]
    )


def _text_cells(count: int) -> str:
    return ", ".join(f"c{i} string" for i in range(count))


def _cell_kind(cell: Column) -> Column:
    kind = F.lit("string")
    for name, pattern in reversed(CSV_CELL.items()):
        kind = F.when(cell.rlike(pattern), F.lit(name)).otherwise(kind)
    return F.when(cell.isNotNull() & (cell != ""), kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header. A value that does not fit its column, or another header, fails the read.

    An empty cell is NULL, quoted or not. ``multiline`` allows line breaks inside quotes, at the
    price of one task per file.
    """
    schema = schema if schema is not None else infer_csv_schema(spark, path, multiline)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    raw = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS, enforceSchema="false", multiLine=str(multiline).lower())
        .csv(path)
    )
    return raw.select(
        *[
            F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in schema.fields
        ]
    )


# -- JSON Lines -------------------------------------------------------------------------------


def _merge_json_type(known: T.DataType | None, new: T.DataType | None) -> T.DataType | None:
    if known is None or new is None or known == new:
        return known if new is None else new
    if isinstance(known, T.StructType) and isinstance(new, T.StructType):
        return _struct_of([*_fields_of(known), *_fields_of(new)])
    if isinstance(known, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(_merge_json_type(known.elementType, new.elementType))
    if {type(known), type(new)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(known, (T.StructType, T.ArrayType)) or isinstance(new, (T.StructType, T.ArrayType)):
        raise InvalidRequest(f"a JSON Lines field is both {known.simpleString()} and {new.simpleString()}")
    return T.StringType()


def _fields_of(struct: T.StructType) -> list[tuple[str, T.DataType | None]]:
    return [(f.name, None if isinstance(f.dataType, T.NullType) else f.dataType) for f in struct.fields]


def _struct_of(fields: list[tuple[str, T.DataType | None]]) -> T.StructType:
    merged: dict[str, T.DataType | None] = {}
    for name, data_type in fields:
        merged[name] = _merge_json_type(merged.get(name), data_type)
    return T.StructType([T.StructField(n, t if t is not None else T.NullType()) for n, t in merged.items()])


def _json_type(value) -> T.DataType | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DoubleType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        items = reduce(_merge_json_type, [_json_type(v) for v in value], None)
        return T.ArrayType(items if items is not None else T.NullType())
    return _struct_of([(k, _json_type(v)) for k, v in value.items()])


def _no_null_types(data_type: T.DataType) -> T.DataType:
    """A field that is null everywhere reads as string."""
    if isinstance(data_type, T.NullType):
        return T.StringType()
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_no_null_types(data_type.elementType))
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, _no_null_types(f.dataType)) for f in data_type.fields])
    return data_type


def _line_schema(line: str) -> T.StructType:
    try:
        value = json.loads(line)
    except ValueError as error:
        raise InvalidRequest(f"a JSON Lines record cannot be read: {error}") from error
    if not isinstance(value, dict):
        raise InvalidRequest("a JSON Lines record is not an object")
    return _json_type(value)


def _schema_row(task: int, schemas: Iterable[T.StructType]) -> pa.RecordBatch:
    """The merged schema as JSON text, or the reason why there is none."""
    merged, error = T.StructType([]), None
    try:
        for schema in schemas:
            if schema != merged:
                merged = _merge_json_type(merged, schema)
    except InvalidRequest as reason:
        error = str(reason)
    return pa.RecordBatch.from_pydict({"task": [task], "schema": [merged.json()], "error": [error]}, SCHEMA_ROW)


SCHEMA_ROW = pa.schema([("task", pa.int64()), ("schema", pa.string()), ("error", pa.string())])
SCHEMA_ROW_DDL = "task long, schema string, error string"
# Tasks whose schemas are merged before they reach the driver.
TASKS_MERGED = 256


def infer_jsonl_schema(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> T.StructType:
    """All fields of all records, merged in the tasks; without any record there are none.

    The driver gets one schema for each 256 tasks.
    """

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in batch.column(0).to_pylist() if line.strip())
        yield _schema_row(TaskContext.get().partitionId(), map(_line_schema, lines))

    def of_tasks(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["task"])
        failed = [r["error"] for r in rows if r["error"]]
        if failed:
            row = pa.RecordBatch.from_pydict({"task": [rows[0]["task"]], "schema": [None], "error": failed[:1]}, SCHEMA_ROW)
        else:
            row = _schema_row(rows[0]["task"], (T.StructType.fromJson(json.loads(r["schema"])) for r in rows))
        return pa.Table.from_batches([row])

    lines = spark.read.options(**(options or {})).text(path).select("value")
    by_task = lines.mapInArrow(of_lines, SCHEMA_ROW_DDL)
    merged = by_task.groupBy(F.floor(F.col("task") / TASKS_MERGED)).applyInArrow(of_tasks, SCHEMA_ROW_DDL)
    schema = T.StructType([])
    for row in sorted(merged.collect(), key=lambda r: r["task"]):
        if row["error"]:
            raise InvalidRequest(row["error"])
        schema = _merge_json_type(schema, T.StructType.fromJson(json.loads(row["schema"])))
    return _no_null_types(schema)


def _with_variants(kind: T.DataType) -> T.DataType:
    """The same type with every text field read as it stands, so that its JSON kind can be told."""
    if isinstance(kind, T.StringType):
        return T.VariantType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_variants(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_variants(f.dataType)) for f in kind.fields])
    return kind


def _only_text(value: Column, kind: T.DataType, name: str) -> Column:
    """Text out of the variants; a number, boolean, list or object in a text field fails the read."""
    if isinstance(kind, T.StringType):
        found = F.schema_of_variant(value)
        error = F.raise_error(F.concat(F.lit(f"JSON Lines field '{name}' is text, found "), found))
        text = F.variant_get(value, "$", "string")
        return F.when(value.isNull() | F.is_variant_null(value), None).when(found == "STRING", text).otherwise(error)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _only_text(item, kind.elementType, name))
    if isinstance(kind, T.StructType):
        parts = [_only_text(value.getField(f.name), f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line. A malformed line or a value of another type fails the read."""
    schema = schema if schema is not None else infer_jsonl_schema(spark, path)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    return _read_lines(spark.read, path, schema)


def _read_lines(reader: DataFrameReader, path: str, schema: T.StructType) -> DataFrame:
    raw = reader.schema(_with_variants(schema)).option("mode", "FAILFAST").json(path)
    return raw.select(*[_only_text(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in schema.fields])


# -- one object, or a folder of mixed formats --------------------------------------------------

READERS = {"parquet": read_parquet, "csv": read_csv, "jsonl": read_jsonl}


def read_object(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """One object path, read by its format."""
    return READERS[detect_format(path, hint)](spark, path)


def _any_case(ending: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in ending)


def read_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder, each by its own format, as one table with a ``format`` column.

    Only the set of formats comes to the driver. Each format is one scan with a name filter, so the
    number of files does not matter.
    """
    formats = [r["format"] for r in list_files(spark, folder).select("format").distinct().collect()]
    if not formats:
        raise NoData(f"no files in {folder}")
    if None in formats:
        raise InvalidRequest(f"{folder} holds files whose format cannot be detected")
    parts = []
    for name in sorted(formats):
        endings = ",".join(f"*.{_any_case(e)}" for e in FORMATS[name])
        own = {"pathGlobFilter": f"{{{endings}}}", "recursiveFileLookup": "true"}
        reader = spark.read.options(**own)
        if name == "parquet":
            part = reader.option("mergeSchema", "true").parquet(folder)
        else:
            schema = (infer_csv_schema if name == "csv" else infer_jsonl_schema)(spark, folder, options=own)
            if not schema.fields:
                continue
            if name == "csv":
                part = reader.schema(schema).options(**CSV_OPTIONS, enforceSchema="false").csv(folder)
                part = part.replace("", None)
            else:
                part = _read_lines(reader, folder, schema)
        parts.append(part.withColumn("format", F.lit(name)))
    if not parts:
        raise NoData(f"no rows in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
