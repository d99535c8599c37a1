"""Document search: mapping, filters, sorting, sizes, projections and keyset pages.

An index is a DataFrame with one row per document and a unique id column. Nested objects are struct
columns and are addressed by dotted paths.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest, NoData
from ..functions.extract import extract_fields
from ..functions.types import spark_type, stringify
from .ranking import fetch_ordered, take_ordered

# Fixed value: the name of the implicit tie-break key in a request's sort list.
TIE_BREAK = "_shard_doc"


# -- mappings and schemas ----------------------------------------------------------------------


def parse_mapping(mapping: Mapping[str, Any]) -> list[tuple[str, str]]:
    """Leaf fields of a mapping as ``(dotted path, type name)``, merged over all its indices.

    A field that has two types becomes ``text``. A mapping without indices is that of one.
    """
    several = [leaf for own in mapping.values() if isinstance(own, Mapping) for leaf in _leaves(own.get("mappings"))]
    types: dict[str, set[str]] = {}
    for path, name in several or _leaves(mapping.get("mappings")):
        types.setdefault(path, set()).add(name)
    return [(path, min(names) if len(names) == 1 else "text") for path, names in types.items()]


def _leaves(node: Any, path: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """All typed fields below an object of a mapping, each as often as it occurs."""
    fields = node.get("properties") if isinstance(node, Mapping) else None
    if isinstance(fields, Mapping):
        return [leaf for name, inner in fields.items() for leaf in _leaves(inner, (*path, name))]
    typed = path and isinstance(node, Mapping) and "properties" not in node and isinstance(node.get("type"), str)
    return [(".".join(path), node["type"])] if typed else []


def mapping_to_schema(fields: Sequence[tuple[str, str]]) -> T.StructType:
    """Flat nullable schema of mapped fields; no field at all is an error."""
    if not fields:
        raise NoData("the mapping has no fields")
    ddl = ", ".join(f"`{path}` {spark_type('elasticsearch', name)}" for path, name in fields)
    return T.StructType.fromDDL(ddl)


def documents(df: DataFrame, doc: str, mapping: Mapping[str, Any], keep: Sequence[str] = ()) -> DataFrame:
    """JSON documents in the text column ``doc`` as typed columns, by their mapping."""
    fields = parse_mapping(mapping)
    mapping_to_schema(fields)
    return extract_fields(df, doc, fields, keep)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of the non-struct fields of a schema."""
    leaves: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            leaves += leaf_paths(f.dataType, f"{prefix}{f.name}.")
        else:
            leaves.append((prefix + f.name, f.dataType))
    return leaves


def path_column(df: DataFrame, path: str) -> Column:
    """A dotted path as a column: a top-level column of that very name, or a struct field."""
    if path in df.columns:
        return F.col(f"`{path}`")
    return F.col(".".join(f"`{step}`" for step in path.split(".")))


def flatten_nested(df: DataFrame) -> DataFrame:
    """Struct columns as flat columns named by their dotted paths; a missing object gives NULL."""
    return df.select(*[path_column(df, path).alias(path) for path, _ in leaf_paths(df.schema)])


def merge_schemas(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several indices as one table. A field with two types becomes text, a missing one NULL."""
    flat = [flatten_nested(f) for f in frames]
    types: dict[str, T.DataType] = {}
    for frame in flat:
        for f in frame.schema.fields:
            known = types.setdefault(f.name, f.dataType)
            if known != f.dataType:
                types[f.name] = T.StringType()
    aligned = [
        frame.select(
            *[
                _retyped(F.col(f"`{f.name}`"), f.dataType, types[f.name]).alias(f.name)
                for f in frame.schema.fields
            ]
        )
        for frame in flat
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return merged.select(*[F.col(f"`{name}`") for name in types])


def _retyped(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return column
    if isinstance(have, (T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast(want)


# -- requests ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchRequest:
    """A parsed search body."""

    index: str | None = None
    query: Mapping[str, Any] = field(default_factory=lambda: {"match_all": {}})
    size: int | None = None
    sort: tuple[tuple[str, str, str], ...] = ()
    source: Any = True


def parse_search(body: str | Mapping[str, Any]) -> SearchRequest:
    """Read a JSON search body; ``_source: false`` is refused because rows come from ``_source``."""
    if isinstance(body, str):
        try:
            body = json.loads(body)
        except ValueError as error:
            raise InvalidRequest(f"the search body is not JSON: {error}") from error
    if not isinstance(body, Mapping):
        raise InvalidRequest("a search body is a JSON object")
    if body.get("_source") is False:
        raise InvalidRequest('"_source": false is not supported; rows are read from _source')
    index, size = body.get("index"), body.get("size")
    return SearchRequest(
        index=index if isinstance(index, str) else None,
        query=body.get("query") or {"match_all": {}},
        size=size if isinstance(size, int) and not isinstance(size, bool) and size >= 0 else None,
        sort=tuple(_sort_keys(body.get("sort", ()))),
        source=body.get("_source", True),
    )


def _sort_keys(sort: Any) -> list[tuple[str, str, str]]:
    entries = [sort] if isinstance(sort, (str, Mapping)) else list(sort)
    keys = []
    for entry in entries:
        if isinstance(entry, str):
            entry = {entry: "asc"}
        for name, how in entry.items():
            how = {"order": how} if isinstance(how, str) else how
            order, missing = how.get("order", "asc"), how.get("missing", "_last")
            if order not in ("asc", "desc") or missing not in ("_first", "_last"):
                raise InvalidRequest(f"unsupported sort for '{name}'")
            keys.append((name, order, missing))
    return keys


def resolve_default_index(request_index: str | None, properties: Mapping[str, str]) -> str:
    """The request's index, else the connection's default one, else an error."""
    index = request_index or properties.get("index")
    if not index:
        raise InvalidRequest("the request names no index and the connection has no default one")
    return index


def default_index_column(request_index: Column, properties: Column) -> Column:
    """The same rule for a table of requests; a request without any index fails the job."""
    index = F.coalesce(request_index, F.try_element_at(properties, F.lit("index")))
    return F.when(index.isNull(), F.raise_error(F.lit("a request without an index"))).otherwise(index)


# -- filters -----------------------------------------------------------------------------------

RANGE_TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def _type_of(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column).schema.fields[0].dataType


def literal(value: Any, kind: T.DataType) -> Column:
    """A request value as a constant that the column's own type is compared with, so it can be pushed down."""
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return F.lit(json.dumps(value) if isinstance(value, bool) else str(value))
    is_time = isinstance(kind, (T.DateType, T.TimestampNTZType))
    if is_time or (isinstance(value, str) and not isinstance(kind, T.StringType)):
        # as text, because a Python datetime would pass through the machine's time zone
        return F.lit(str(value)).cast(kind)
    return F.lit(value)


def _single(clause: Mapping[str, Any], kind: str) -> tuple[str, Any]:
    if len(clause) != 1:
        raise InvalidRequest(f"a {kind} clause takes exactly one field")
    return next(iter(clause.items()))


def search_term(df: DataFrame, path: str, value: Any) -> Column:
    """Exact value; on an array column, any of its elements."""
    column = path_column(df, path)
    kind = _type_of(df, column)
    if isinstance(kind, T.ArrayType):
        return F.array_contains(column, literal(value, kind.elementType))
    return column == literal(value, kind)


def search_terms(df: DataFrame, path: str, values: Sequence[Any]) -> Column:
    """Any of the exact values; on an array column, of any of its elements."""
    column = path_column(df, path)
    kind = _type_of(df, column)
    if isinstance(kind, T.ArrayType):
        return F.arrays_overlap(column, F.array(*[literal(v, kind.elementType) for v in values]).cast(kind))
    return column.isin(*[literal(v, kind) for v in values])


def search_range(df: DataFrame, path: str, **bounds: Any) -> Column:
    """All given bounds out of ``gt``, ``gte``, ``lt``, ``lte``."""
    unknown = set(bounds) - set(RANGE_TESTS)
    if unknown or not bounds:
        raise InvalidRequest(f"unsupported range bounds for '{path}': {sorted(unknown)}")
    column = path_column(df, path)
    kind = _type_of(df, column)
    tests = [RANGE_TESTS[name](column, literal(value, kind)) for name, value in bounds.items()]
    return reduce(lambda a, b: a & b, tests)


# Fixed value: what stands between the words of a text.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


def _on_text(df: DataFrame, path: str, test: Callable[[Column], Column]) -> Column:
    """A test on the text form of a column; on an array column, of any of its elements."""
    column = path_column(df, path)
    if isinstance(_type_of(df, column), T.ArrayType):
        return F.exists(column, lambda x: test(x.cast("string")))
    return test(column.cast("string"))


def search_prefix(df: DataFrame, path: str, value: str) -> Column:
    return _on_text(df, path, lambda c: c.startswith(F.lit(value)))


def search_wildcard(df: DataFrame, path: str, pattern: str) -> Column:
    """``*`` is any text, ``?`` any sign, and a backslash takes the next sign as it is."""
    like, signs = "", iter(pattern)
    for sign in signs:
        if sign in "*?":
            like += "%" if sign == "*" else "_"
            continue
        sign = next(signs, sign) if sign == "\\" else sign
        like += f"\\{sign}" if sign in "%_\\" else sign
    return _on_text(df, path, lambda c: c.like(like))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")


def asked_words(text: Any) -> list[str]:
    return re.findall(r"\w+", str(text).lower())


def search_match(df: DataFrame, path: str, text: Any, operator: str = "or") -> Column:
    """Any of the words of ``text``, or all with ``and``, whatever their case. No words match nothing."""
    asked = list(dict.fromkeys(asked_words(text)))
    if operator.lower() not in ("or", "and"):
        raise InvalidRequest(f"unknown match operator '{operator}'")
    if not asked:
        return F.lit(False)
    if operator.lower() == "or":
        return _on_text(df, path, lambda c: F.arrays_overlap(words_of(c), F.array(*map(F.lit, asked))))
    return _on_text(df, path, lambda c: reduce(lambda a, b: a & b, [F.array_contains(words_of(c), w) for w in asked]))


def search_match_phrase(df: DataFrame, path: str, text: Any) -> Column:
    """The words of ``text``, one after the other. No words match nothing."""
    asked = asked_words(text)
    if not asked:
        return F.lit(False)
    phrase = F.lit(f" {' '.join(asked)} ")
    return _on_text(df, path, lambda c: F.concat(F.lit(" "), F.array_join(words_of(c), " "), F.lit(" ")).contains(phrase))


TEXT_TESTS: dict[str, tuple[Callable[..., Column], str, tuple[str, ...]]] = {
    "prefix": (search_prefix, "value", ()),
    "wildcard": (search_wildcard, "value", ()),
    "match": (search_match, "query", ("operator",)),
    "match_phrase": (search_match_phrase, "query", ()),
}


def _text_condition(df: DataFrame, kind: str, clause: Mapping[str, Any]) -> Column:
    test, main, more = TEXT_TESTS[kind]
    path, given = _single(clause, kind)
    given = dict(given) if isinstance(given, Mapping) else {main: given}
    if main not in given or set(given) - {main, *more}:
        raise InvalidRequest(f"unsupported settings of a {kind} clause: {sorted(given)}")
    return test(df, path, given.pop(main), **given)


def condition(df: DataFrame, query: Mapping[str, Any], id_column: str | None = None) -> Column | None:
    """A query clause as a filter on ``df``; None for match_all."""
    kind, clause = _single(query, "query")
    if kind == "match_all":
        return None
    if kind == "term":
        path, value = _single(clause, kind)
        return search_term(df, path, value["value"] if isinstance(value, Mapping) else value)
    if kind == "terms":
        path, values = _single(clause, kind)
        return search_terms(df, path, values)
    if kind == "range":
        path, bounds = _single(clause, kind)
        return search_range(df, path, **bounds)
    if kind == "exists":
        return path_column(df, clause["field"]).isNotNull()
    if kind in TEXT_TESTS:
        return _text_condition(df, kind, clause)
    if kind == "ids" and id_column:
        return search_terms(df, id_column, clause["values"])
    if kind == "bool":
        return _bool_condition(df, clause, id_column)
    raise InvalidRequest(f"unsupported query clause '{kind}'")


def _clauses(df: DataFrame, clause: Mapping[str, Any], name: str, id_column: str | None) -> list[Column]:
    given = clause.get(name, [])
    given = [given] if isinstance(given, Mapping) else given
    return [c if c is not None else F.lit(True) for c in (condition(df, q, id_column) for q in given)]


def _bool_condition(df: DataFrame, clause: Mapping[str, Any], id_column: str | None) -> Column | None:
    needed = _clauses(df, clause, "must", id_column) + _clauses(df, clause, "filter", id_column)
    optional = _clauses(df, clause, "should", id_column)
    tests = list(needed)
    if optional:
        least = clause.get("minimum_should_match", 0 if needed else 1)
        if least == 1:
            tests.append(reduce(lambda a, b: a | b, optional))
        elif least > 1:
            hits = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in optional])
            tests.append(hits >= least)
    # a missing value does not match the inner clause, so its negation holds
    tests += [~F.coalesce(c, F.lit(False)) for c in _clauses(df, clause, "must_not", id_column)]
    return reduce(lambda a, b: a & b, tests) if tests else None


# -- sorting, projection, pages ----------------------------------------------------------------


def sort_keys(sort: Sequence[tuple[str, str, str]], id_column: str) -> list[tuple[str, str, str]]:
    """The user's keys, then the unique id ascending; not a second time if it is there already."""
    keys = [(id_column if name == TIE_BREAK else name, order, missing) for name, order, missing in sort]
    if id_column not in [name for name, _, _ in keys]:
        keys.append((id_column, "asc", "_last"))
    return keys


def ordering(df: DataFrame, keys: Sequence[tuple[str, str, str]]) -> list[Column]:
    return [getattr(path_column(df, name), f"{order}_nulls{missing}")() for name, order, missing in keys]


def selects(source: Any, path: str) -> bool:
    """Does a ``_source`` setting (true, name, list of patterns, includes/excludes) select a field?"""
    if source is True or source is None:
        return True
    if isinstance(source, Mapping):
        includes, excludes = source.get("includes", ["*"]), source.get("excludes", [])
    else:
        includes, excludes = source, []
    as_list = lambda names: [names] if isinstance(names, str) else names
    matches = lambda names: any(
        fnmatchcase(path, name) or fnmatchcase(path, f"{name}.*") for name in as_list(names)
    )
    return matches(includes) and not matches(excludes)


def source_project(df: DataFrame, source: Any) -> DataFrame:
    """Every mapped field stays in the schema; fields that ``_source`` leaves out are NULL.

    Lists and maps come as JSON text.
    """
    columns = []
    for path, kind in leaf_paths(df.schema):
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.VariantType))
        if selects(source, path):
            column = stringify(path_column(df, path), kind) if nested else path_column(df, path)
        else:
            column = F.lit(None).cast("string" if nested else kind)
        columns.append(column.alias(path))
    return df.select(*columns)


def _served(df: DataFrame, query: Mapping[str, Any], id_column: str, index: Any) -> tuple[DataFrame, Mapping[str, Any], list[str]]:
    """The query with the clauses that a text index can answer turned into tests of a column each, which ``df`` gets by its id."""
    from . import postings

    marks: list[str] = []

    def walk(clause: Any) -> Any:
        nonlocal df
        if isinstance(clause, (list, tuple)):
            return [walk(c) for c in clause]
        kind, inner = next(iter(clause.items())) if isinstance(clause, Mapping) and len(clause) == 1 else (None, None)
        if kind == "bool":
            return {kind: {k: walk(v) if k in ("must", "filter", "should", "must_not") else v for k, v in inner.items()}}
        if kind not in ("match", "match_phrase") or next(iter(inner), None) not in index.fields:
            return clause
        field, given = _single(inner, kind)
        given = dict(given) if isinstance(given, Mapping) else {"query": given}
        if set(given) - {"query", *(("operator",) if kind == "match" else ())}:
            return clause
        find = postings.matching if kind == "match" else postings.matching_phrase
        hits = find(df.sparkSession, index, field, given.pop("query"), **given)
        marks.append(f"__hit_{len(marks)}")
        df = df.join(hits.select(F.col("id").alias(f"{marks[-1]}_id"), F.lit(True).alias(marks[-1])), path_column(df, id_column) == F.col(f"{marks[-1]}_id"), "left")
        return {"exists": {"field": marks[-1]}}

    query = walk(query)
    return df, query, [c for m in marks for c in (m, f"{m}_id")]


def search(
    df: DataFrame, body: str | Mapping[str, Any] | SearchRequest, id_column: str, late: bool = False, text_index: Any = None
) -> DataFrame:
    """Filter, order, cut and project an index as a search body asks.

    Without a sort the rows of a full result come in no particular order; a ``size`` cuts in tie-break
    order, so that the same request gives the same rows. ``late`` finds the ids of a small cut with a
    job of its own and then reads only their rows. A ``text_index`` (see ``postings``) answers the match and match_phrase clauses on its
    fields; a document that it doesn't know doesn't match them.
    """
    request = body if isinstance(body, SearchRequest) else parse_search(body)
    query, marks = request.query, []
    if text_index is not None:
        df, query, marks = _served(df, query, id_column, text_index)
    test = condition(df, query, id_column)
    hits = df if test is None else df.where(test)
    order = ordering(df, sort_keys(request.sort, id_column))
    if request.size is not None:
        hits = fetch_ordered(hits, order, request.size, id_column) if late else take_ordered(hits, order, request.size)
    elif request.sort:
        hits = hits.orderBy(*order)
    return source_project(hits.drop(*marks), request.source)


def after_key(df: DataFrame, keys: Sequence[tuple[str, str, str]], after: Sequence[Any]) -> Column:
    """Rows that sort strictly behind the key values ``after``.

    The outermost term is a plain test on the first key, so file statistics can skip data.
    """
    if len(after) != len(keys):
        raise InvalidRequest(f"search_after needs {len(keys)} values, got {len(after)}")
    (name, order, missing), value = keys[0], after[0]
    column = path_column(df, name)
    nulls_behind = missing == "_last"
    if value is None:
        ties = column.isNull()
        behind = F.lit(False) if nulls_behind else column.isNotNull()
        at_or_behind = None
    else:
        last = literal(value, _type_of(df, column))
        ties = column == last
        behind = column > last if order == "asc" else column < last
        at_or_behind = column >= last if order == "asc" else column <= last
        if nulls_behind:
            behind, at_or_behind = behind | column.isNull(), at_or_behind | column.isNull()
    if len(keys) == 1:
        return behind
    inner = behind | (ties & after_key(df, keys[1:], after[1:]))
    return inner if at_or_behind is None else at_or_behind & inner


def page_after(
    df: DataFrame,
    sort: Sequence[tuple[str, str, str]],
    id_column: str,
    after: Sequence[Any] | None = None,
    page_size: int = 512,
) -> DataFrame:
    """The next page of a sorted index behind the last row's key values; None gives the first page.

    A DataFrame lists its files once, when it is made, so pages of the same ``df`` see one snapshot.
    The last page is the first one that is shorter than ``page_size``.
    """
    keys = sort_keys(sort, id_column)
    rest = df if after is None else df.where(after_key(df, keys, after))
    return take_ordered(rest, ordering(df, keys), page_size)


def next_key(row: Any, sort: Sequence[tuple[str, str, str]], id_column: str) -> list[Any]:
    """The ``after`` value of the page that follows one ending with ``row``."""
    return [row[name] for name, _, _ in sort_keys(sort, id_column)]
