"""Read-only SQL text over registered tables (S11) and the schema of a query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import SqlError


def register_tables(spark: SparkSession, location: str, names: Sequence[str]) -> None:
    """Temporary views over Parquet tables; ``location`` holds ``{name}``, e.g. ``/data/{name}.parquet``."""
    for name in names:
        spark.read.parquet(location.replace("{name}", name)).createOrReplaceTempView(name)


# The functions that run Java code.
JAVA_CALLS = ("reflect", "try_reflect", "java_method")
# Leaves of an analysed plan that read nothing: rows written in the text, ranges, and names of the text itself.
INLINE = ("OneRowRelation", "LocalRelation", "EmptyRelation", "Range", "CTERelationRef", "UnionLoopRef")


def _without_java(session: SparkSession) -> SparkSession:
    """Drops the functions that run Java code from a session's own list, so that no spelling of their names finds them."""
    functions = session._jsparkSession.sessionState().functionRegistry()
    for name in JAVA_CALLS:
        functions.dropFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return session


def _copy(spark: SparkSession) -> SparkSession:
    """A session with the settings, views and functions of another one, but for Java calls. What it changes stays in it."""
    return _without_java(SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession()))


def _alone(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session with the settings of another one that knows these tables as views, and no other views, functions or paths."""
    session = _copy(spark)
    catalog = session._jsparkSession.sessionState().catalog()
    known = catalog.listTempViews("default", "*")
    for i in range(known.size()):
        catalog.dropTempView(known.apply(i).identifier().table())
    for found in session.catalog.listFunctions():
        if found.isTemporary and found.className and not found.className.startswith("org.apache.spark.sql.catalyst."):
            catalog.dropTempFunction(found.name, True)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    frames = getattr(spark._jvm, "org.apache.spark.sql.classic.Dataset")
    for name, table in tables.items():
        frames.ofRows(session._jsparkSession, table._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return session


def _refuse_others(plan: Any, allowed: set[str]) -> None:
    """Walks an analysed plan: what it reads has to be one of the views, whose own plans aren't looked into."""
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier()
            if name.database().isDefined() or name.table().lower() not in allowed:
                raise SqlError(f"'{name.unquotedString()}' is not a table of this connection")
            continue
        children, inner = node.children(), node.subqueries()
        if children.isEmpty() and kind not in INLINE:
            raise SqlError(f"the query reads what is not a table of this connection ({kind})")
        nodes += [seq.apply(i) for seq in (children, inner) for i in range(seq.size())]


def _reason(error: AnalysisException, confined: bool) -> str:
    """What to say about a query that can't be analysed."""
    named = {str(x).strip("`").rpartition("`.`")[2] for x in (error.getMessageParameters() or {}).values()}
    if "ROUTINE" in (error.getCondition() or "") and named & set(JAVA_CALLS):
        return f"a query can't call Java code: {error}"
    if confined and error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
        return f"not a table of this connection: {error}"
    return str(error)


def sql_read(
    spark: SparkSession,
    text: str,
    args: Mapping[str, Any] | Sequence[Any] | None = None,
    tables: Mapping[str, DataFrame] | Sequence[str] | None = None,
) -> DataFrame:
    """Run one SELECT. As a sub-query, no statement that changes data or settings can parse.

    ``args`` binds ``:name`` markers (mapping) or ``?`` markers (sequence). ``tables`` are the only ones that the text may read: frames
    by name, or names of the session's views. Such a text is analysed in a session of its own, which knows nothing else; the names it
    has for its tables aren't seen by other queries. No text can run Java code.
    """
    body = text.strip().rstrip(";")
    wrapped = f"SELECT * FROM (\n{body}\n) q"
    if args is not None and not isinstance(args, Mapping):
        args = list(args)
    try:
        if tables is None:
            session = _copy(spark)
        else:
            frames = tables if isinstance(tables, Mapping) else {t: spark.table(t) for t in tables}
            session = _alone(spark, frames)
        found = session.sql(wrapped, args=args) if args else session.sql(wrapped)
        if tables is not None:
            _refuse_others(found._jdf.queryExecution().analyzed(), {t.lower() for t in frames})
        return found
    except ParseException as error:
        raise SqlError(f"not a read-only query: {error}") from error
    except AnalysisException as error:
        raise SqlError(_reason(error, tables is not None)) from error


def describe_query(df: DataFrame) -> DataFrame:
    """``(position, name, type, nullable)`` of a result; only analysis runs, no job."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
