"""SQL text against a database over JDBC."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest, SourceUnavailable

DEFAULT_FETCH = 10_000


def jdbc_target(url: str) -> tuple[str, dict[str, str]]:
    """``postgresql://user:pw@host:5432/db`` -> JDBC URL and login properties; JDBC URLs pass through."""
    if url.startswith("jdbc:"):
        return url, {}
    parts = urlsplit(url)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname:
        raise SourceUnavailable(f"cannot make a JDBC URL out of scheme '{parts.scheme}'")
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    target = f"jdbc:postgresql://{host}{parts.path}" + (f"?{parts.query}" if parts.query else "")
    login = {"user": unquote(parts.username or ""), "password": unquote(parts.password or "")}
    return target, {k: v for k, v in login.items() if v}


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    num_partitions: int | None = None,
    fetch_size: int = DEFAULT_FETCH,
) -> dict[str, str]:
    """Options of one read. The text is a sub-query, so statements that change data do not parse."""
    target, login = jdbc_target(url)
    options = {
        "url": target,
        "dbtable": f"(\n{query.strip().rstrip(';')}\n) q",
        "fetchsize": str(fetch_size),
        "preferTimestampNTZ": "true",
        **login,
    }
    if target.startswith("jdbc:postgresql:"):
        options["sessionInitStatement"] = "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"
    if partition_column is not None:
        if bounds is None or not num_partitions:
            raise InvalidRequest("a partitioned read needs bounds and num_partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(num_partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    num_partitions: int | None = None,
    bounds: tuple[object, object] | None = None,
    fetch_size: int = DEFAULT_FETCH,
) -> DataFrame:
    """Rows of a SQL text, in ``num_partitions`` parallel range reads when a column is given.

    The bounds are asked of the database (one row) unless given. Decimals come as text.
    """
    if partition_column is not None and bounds is None:
        ends = f"SELECT min({partition_column}) lo, max({partition_column}) hi FROM (\n{query.strip().rstrip(';')}\n) b"
        row = spark.read.format("jdbc").options(**jdbc_options(url, ends)).load().first()
        bounds = None if row[0] is None else (row[0], row[1])
        if bounds is None:
            partition_column = None
    options = jdbc_options(url, query, partition_column, bounds, num_partitions, fetch_size)
    return decimals_as_text(spark.read.format("jdbc").options(**options).load())


def decimals_as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
