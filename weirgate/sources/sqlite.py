"""SQL text against SQLite files, one task per file and key range.

A file is opened read-only on the executor that reads it, so its path has to be on storage that is
mounted on all executors. A folder of files with the same tables is read as one source.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidRequest, SourceUnavailable, SqlError
from ..functions.types import SQLITE_TYPES

READ_ROWS = 10_000

# SQLite's own name of a value's class -> the declared type it stands for.
VALUE_CLASSES = {"integer": "INTEGER", "real": "REAL", "blob": "BLOB"}

ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
SPARK = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def local_path(url: str) -> str:
    """``sqlite:///data/x.db``, ``file:///data/x.db`` or a plain path -> a path to open."""
    if "://" not in url:
        return url.removeprefix("sqlite:").removeprefix("file:")
    parts = urlsplit(url)
    if parts.scheme not in ("sqlite", "file"):
        raise SourceUnavailable(f"SQLite files need a mounted path, not {parts.scheme}://")
    return parts.netloc + parts.path


def database_files(path: str) -> list[str]:
    path = local_path(path)
    files = sorted(glob.glob(os.path.join(path, "*.db"))) if os.path.isdir(path) else [path]
    if not files or not os.path.exists(files[0]):
        raise SourceUnavailable(f"no SQLite file at {path}")
    return files


def _open(path: str, query: str) -> sqlite3.Connection:
    """Read-only connection with the text as view ``q``: only a single SELECT can become a view."""
    connection = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    try:
        connection.execute(f"CREATE TEMP VIEW q AS {query.strip().rstrip(';')}")
    except sqlite3.Error as error:
        connection.close()
        raise SqlError(str(error)) from error
    connection.execute("PRAGMA query_only = ON")
    return connection


def query_schema(path: str, query: str) -> T.StructType:
    """Declared types decide; an expression without one is typed by its value in the first row."""
    connection = _open(path, query)
    try:
        columns = [(row[1], row[2].upper()) for row in connection.execute("PRAGMA temp.table_info(q)")]
        first = None
        if any(not declared for _, declared in columns):
            kinds = ", ".join(f'typeof("{name}")' for name, _ in columns)
            first = connection.execute(f"SELECT {kinds} FROM q LIMIT 1").fetchone()
        fields = []
        for i, (name, declared) in enumerate(columns):
            if not declared and first:
                declared = VALUE_CLASSES.get(first[i], "")
            fields.append(T.StructField(name, SPARK.get(SQLITE_TYPES.get(declared), T.StringType())))
        return T.StructType(fields)
    finally:
        connection.close()


@dataclass
class FileRange(InputPartition):
    path: str
    condition: str


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_readonly")`` with ``path``, ``query`` and optional ranges."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_readonly"

    def schema(self) -> T.StructType:
        return query_schema(database_files(self.options["path"])[0], self.options["query"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path = options["path"]
        self.query = options["query"]
        self.schema = schema
        # option names arrive in lower case
        self.column = options.get("partitioncolumn")
        self.pieces = int(options.get("numpartitions", "1"))

    def partitions(self) -> list[InputPartition]:
        files = database_files(self.path)
        if len(files) >= self.pieces:
            # the files alone keep enough tasks busy
            return [FileRange(f, "") for f in files]
        return [FileRange(f, c) for f in files for c in self._conditions(f)]

    def _conditions(self, path: str) -> list[str]:
        if not self.column or self.pieces < 2:
            return [""]
        column = '"' + self.column.replace('"', '""') + '"'
        connection = _open(path, self.query)
        low, high = connection.execute(f"SELECT min({column}), max({column}) FROM q").fetchone()
        connection.close()
        if low is None:
            return [""]
        if not isinstance(low, int) or not isinstance(high, int):
            raise InvalidRequest("the partition column has to hold whole numbers")
        step = max(1, -(-(high - low + 1) // self.pieces))
        cuts = list(range(low + step, high + 1, step))
        edges = [None, *cuts, None]
        conditions = []
        for start, stop in zip(edges, edges[1:]):
            parts = [f"{column} >= {start}"] if start is not None else []
            parts += [f"{column} < {stop}"] if stop is not None else []
            text = " AND ".join(parts)
            if start is None and text:
                text = f"({text} OR {column} IS NULL)"
            conditions.append(f" WHERE {text}" if text else "")
        return conditions

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        types = [ARROW.get(f.dataType.simpleString(), pa.string()) for f in self.schema.fields]
        names = [f.name for f in self.schema.fields]
        connection = _open(partition.path, self.query)
        try:
            cursor = connection.execute("SELECT * FROM q" + partition.condition)
            while rows := cursor.fetchmany(READ_ROWS):
                arrays = [pa.array(_as_type(col, kind), kind) for col, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            connection.close()


def _as_type(values: tuple, kind: pa.DataType) -> list:
    if pa.types.is_string(kind):
        return [v if v is None or isinstance(v, str) else _text(v) for v in values]
    if pa.types.is_boolean(kind):
        return [None if v is None else bool(v) for v in values]
    if pa.types.is_floating(kind):
        return [None if v is None else float(v) for v in values]
    return list(values)


def _text(value: object) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def read_sqlite(
    spark: SparkSession,
    path: str,
    query: str,
    partition_column: str | None = None,
    num_partitions: int = 1,
) -> DataFrame:
    """Rows of a SQL text from one SQLite file or a folder of ``*.db`` files with the same tables.

    On a folder the text runs in each file, and the rows are put together: it should select and
    filter, and leave grouping to Spark.
    """
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_readonly").option("path", path).option("query", query)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("numPartitions", str(num_partitions))
    return reader.load()
