"""Document search over the documents, orders and events tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import pages, postings, search
from ..operators.ranking import with_place
from ..session import scratch_path
from .tables import location, table

# -- JSON documents made of events ---------------------------------------------------------------

MAPPING = {
    "events": {
        "mappings": {
            "properties": {
                "id": {"type": "long"},
                "user": {"properties": {"id": {"type": "integer"}, "kind": {"type": "keyword"}}},
                "value": {"type": "double"},
                "missing": {"properties": {"deep": {"type": "keyword"}}},
            }
        }
    }
}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, doc)``; ``mixed`` has another JSON kind for every event type."""
    whole = F.floor(F.col("value")).cast("bigint")
    mixed = (
        F.when(F.col("event_type") == "click", _text(',"mixed":', whole))
        .when(F.col("event_type") == "view", _text(',"mixed":"', whole, '"'))
        .when(F.col("event_type") == "purchase", _text(',"mixed":', whole, ".5"))
        .when(F.col("event_type") == "error", _text(',"mixed":', F.col("value") > 10))
        .otherwise(_text(',"mixed":null'))
    )
    instant = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = (
        F.when(F.col("event_type") == "click", _text(',"at":"', instant, 'Z"'))
        .when(F.col("event_type") == "view", _text(',"at":"', instant, '+02:00"'))
        .when(F.col("event_type") == "purchase", _text(',"at":"', instant, '"'))
        .when(F.col("event_type") == "error", _text(',"at":', F.col("event_id") * 1000 + 1))
        .otherwise(_text(',"at":"', F.date_format("ts", "yyyy-MM-dd"), '"'))
    )
    doc = _text(
        '{"id":', F.col("event_id"),
        ',"user":{"id":', F.col("user_id"), ',"kind":"', F.col("event_type"), '"}',
        ',"value":', F.col("value"), ',"props":', F.col("props"), mixed, at, "}",
    )
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


def _extracted(name: str, build: Callable[[Column], Column], path: str = "mixed") -> Callable[..., DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = extract.parsed(event_json(spark, sf_dir), "doc")
        return docs.select("event_id", build(extract.value_at(F.col(extract.PARSED), path)).alias(name))

    return run


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ("mixed", "props", "user", "nothing", "user.kind")
    read = extract.extract_typed(event_json(spark, sf_dir), "doc", [(p, "string") for p in paths], ["event_id"])
    return read.toDF(*[c.replace(".", "_") for c in read.columns])


def mapping_to_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = search.documents(event_json(spark, sf_dir), "doc", MAPPING, ["event_id"])
    return typed.toDF(*[c.replace(".", "_") for c in typed.columns])


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    nested = events.select(
        "event_id",
        F.struct(
            F.col("user_id").alias("id"),
            F.when(F.col("event_type") != "view", F.struct(F.col("event_type").alias("name"))).alias("kind"),
        ).alias("user"),
        F.from_json("props", "k int, q struct<z: string>").alias("props"),
    )
    flat = search.flatten_nested(nested)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


def merge_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.select("event_id", F.col("user_id").alias("who"), "value")
    second = events.select("event_id", F.col("event_type").alias("who"), "props")
    return search.merge_schemas([first, second])


def narrow_int_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") * 1_000_003 - 500_000_000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        extract.wrap_int(key, "tinyint").cast("int").alias("as_byte"),
        extract.wrap_int(key, "smallint").cast("int").alias("as_short"),
        extract.wrap_int(key, "int").alias("as_int"),
    )


# -- searches ------------------------------------------------------------------------------------


def _search(body: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(table(spark, sf_dir, "documents"), body, "doc_id", late=True)

    return run


BOOL_QUERY = {
    "bool": {
        "filter": [{"range": {"n_chars": {"gt": 200}}}],
        "must_not": [{"term": {"lang": "de"}}],
        "should": [{"term": {"source": "src1"}}, {"terms": {"source": ["src2", "src3"]}}],
        "minimum_should_match": 1,
    }
}
BODIES = {
    "search_match_all": {"query": {"match_all": {}}},
    "search_term": {"query": {"term": {"lang": "en"}}},
    "search_range": {"query": {"range": {"n_chars": {"gte": 300, "lt": 5000}}}},
    "search_bool": {"query": BOOL_QUERY},
    "search_prefix": {"query": {"prefix": {"source": "src1"}}},
    "search_wildcard": {"query": {"wildcard": {"source": {"value": "s?c*2"}}}},
    "search_ids": {"query": {"ids": {"values": [0, 5, 17, 40, 160, 99_999_999]}}},
    "search_match": {"query": {"match": {"text": "Worthless, oredat"}}},
    "search_match_all_words": {"query": {"match": {"text": {"query": "the AND of", "operator": "and"}}}},
    "search_match_phrase": {"query": {"match_phrase": {"text": "with by"}}},
    "search_size": {"query": {"term": {"lang": "en"}}, "size": 25},
    "search_source_project": {"_source": ["doc_id", "lang", "n_*"]},
}

_text_indexes: dict[tuple[str, str], str] = {}


def _text_index(spark: SparkSession, sf_dir: str) -> postings.TextIndex:
    """The index of the documents: built once per application, opened again by its path after that."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _text_indexes:
        _text_indexes[key] = postings.build_text_index(table(spark, sf_dir, "documents"), "doc_id", ["text"]).path
    return postings.open_text_index(spark, _text_indexes[key])


def _indexed(body: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(table(spark, sf_dir, "documents"), body, "doc_id", text_index=_text_index(spark, sf_dir))

    return run


INDEXED_BOOL = {
    "bool": {
        "must": [{"match": {"text": {"query": "the of", "operator": "and"}}}],
        "should": [{"match_phrase": {"text": "with by"}}, {"match": {"text": "worthless"}}, {"term": {"source": "src1"}}],
        "minimum_should_match": 1,
        "must_not": [{"match": {"text": "idiot"}}],
    }
}
INDEXED = {
    "index_match": BODIES["search_match"],
    "index_match_all_words": BODIES["search_match_all_words"],
    "index_match_phrase": BODIES["search_match_phrase"],
    "index_match_bool": {"query": INDEXED_BOOL},
}

PAGE_SORT = (("o_orderdate", "desc", "_last"), ("o_orderpriority", "asc", "_last"))


def search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, longest first, with their place in the order."""
    request = search.parse_search({"query": {"match_all": {}}, "sort": [{"n_chars": "desc"}]})
    hits = search.search(table(spark, sf_dir, "documents"), request, "doc_id")
    return with_place(hits, search.ordering(hits, search.sort_keys(request.sort, "doc_id")))


def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the orders, newest first."""
    orders = table(spark, sf_dir, "orders")
    after = None
    for _ in range(2):
        page = search.page_after(orders, PAGE_SORT, "o_orderkey", after, 200).collect()
        if not page:
            break
        after = search.next_key(page[-1], PAGE_SORT, "o_orderkey")
    return search.page_after(orders, PAGE_SORT, "o_orderkey", after, 200)


def page_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a snapshot of the orders, each page in a session of its own."""
    root = scratch_path(spark, "snapshots")
    snapshot, after = pages.take_snapshot(spark, location(sf_dir).replace("{name}", "orders"), root), None
    for _ in range(2):
        page = search.page_after(pages.open_snapshot(spark.newSession(), root, snapshot), PAGE_SORT, "o_orderkey", after, 200)
        # Of a page only its last key is needed.
        last = page.select(*[name for name, _, _ in search.sort_keys(PAGE_SORT, "o_orderkey")]).tail(1)
        if not last:
            break
        after = search.next_key(last[0], PAGE_SORT, "o_orderkey")
    return search.page_after(pages.open_snapshot(spark, root, snapshot), PAGE_SORT, "o_orderkey", after, 200)


_page_indexes: dict[tuple[str, str], str] = {}


def _page_index(spark: SparkSession, sf_dir: str) -> pages.PageIndex:
    """The orders, newest first, in parts of 5,000 rows: built once per application, opened again by its path after that."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _page_indexes:
        _page_indexes[key] = pages.build_page_index(table(spark, sf_dir, "orders"), PAGE_SORT, "o_orderkey", part_rows=5000).path
    return pages.open_page_index(spark, _page_indexes[key])


def page_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 6 of the orders, by its number."""
    return pages.page_number(spark, _page_index(spark, sf_dir), 6, 200)


def page_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders behind the newest one of medium priority of a day."""
    return pages.page_behind(spark, _page_index(spark, sf_dir), ["1996-06-15", "3-MEDIUM", 0], 300)


def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their place."""
    return pages.places(spark, _page_index(spark, sf_dir))


QUERIES = {
    "mapping_to_schema": mapping_to_schema,
    "flatten_nested": flatten_nested,
    "merge_schemas": merge_schemas,
    "extract_bool": _extracted("mixed", extract.as_bool),
    "extract_int": _extracted("mixed", extract.as_int),
    "extract_float": _extracted("mixed", extract.as_float),
    "extract_timestamp": _extracted("millis", lambda v: F.unix_millis(extract.as_instant(v)), "at"),
    "extract_text": extract_text,
    "narrow_int_wrap": narrow_int_wrap,
    "search_sort": search_sort,
    "page_after": page_after,
    "page_snapshot": page_snapshot,
    "page_numbered": page_numbered,
    "page_behind": page_behind,
    "page_places": page_places,
} | {name: _search(body) for name, body in BODIES.items()} | {name: _indexed(body) for name, body in INDEXED.items()}


def _wrapped(value: str, bits: int) -> str:
    half, full = 2 ** (bits - 1), 2**bits
    return f"CAST(((({value} + {half}) % {full}) + {full}) % {full} - {half} AS INT)"


_KEY = "(o_orderkey * 1000003 - 500000000)"

_PLACED = "SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS place FROM orders"

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"

ORACLE = {
    "mapping_to_schema": """
        SELECT event_id, event_id AS id, CAST(user_id AS INT) AS user_id, event_type AS user_kind, value,
               CAST(NULL AS VARCHAR) AS missing_deep
        FROM events
    """,
    "flatten_nested": """
        SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS user_kind_name,
               CAST(json_extract(props, '$.k') AS INT) AS props_k, CAST(NULL AS VARCHAR) AS props_q_z
        FROM events
    """,
    "merge_schemas": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS who, value, CAST(NULL AS VARCHAR) AS props FROM events
        UNION ALL
        SELECT event_id, event_type, NULL, props FROM events
    """,
    "extract_bool": "SELECT event_id, CASE WHEN event_type = 'error' THEN value > 10 END AS mixed FROM events",
    "extract_int": """
        SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) END AS mixed FROM events
    """,
    "extract_float": """
        SELECT event_id, CASE event_type WHEN 'click' THEN floor(value) WHEN 'purchase' THEN floor(value) + 0.5 END AS mixed
        FROM events
    """,
    "extract_timestamp": """
        SELECT event_id, CASE event_type
                 WHEN 'click' THEN epoch_us(ts) // 1000 WHEN 'view' THEN epoch_us(ts) // 1000 - 7200000
                 WHEN 'purchase' THEN epoch_us(ts) // 1000
                 WHEN 'error' THEN event_id * 1000 + 1 END AS millis
        FROM events
    """,
    "extract_text": """
        SELECT event_id,
               CASE event_type WHEN 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                 WHEN 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
                 WHEN 'purchase' THEN CAST(floor(value) + 0.5 AS VARCHAR)
                 WHEN 'error' THEN CASE WHEN value > 10 THEN 'true' ELSE 'false' END ELSE 'null' END AS mixed,
               replace(props, ' ', '') AS props,
               concat('{"id":', user_id, ',"kind":"', event_type, '"}') AS user, CAST(NULL AS VARCHAR) AS nothing,
               event_type AS user_kind
        FROM events
    """,
    "narrow_int_wrap": f"""
        SELECT o_orderkey, {_wrapped(_KEY, 8)} AS as_byte, {_wrapped(_KEY, 16)} AS as_short, {_wrapped(_KEY, 32)} AS as_int
        FROM orders
    """,
    "page_after": """
        SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey LIMIT 200 OFFSET 400
    """,
    "page_snapshot": """
        SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey LIMIT 200 OFFSET 400
    """,
    "page_numbered": f"SELECT * FROM ({_PLACED}) WHERE place > 1200 AND place <= 1400",
    "page_behind": f"""
        SELECT * FROM ({_PLACED})
        WHERE (o_orderdate, o_orderpriority, o_orderkey) IS DISTINCT FROM (DATE '1996-06-15', '3-MEDIUM', 0)
          AND (o_orderdate < DATE '1996-06-15' OR o_orderdate = DATE '1996-06-15' AND o_orderpriority >= '3-MEDIUM')
        ORDER BY place LIMIT 300
    """,
    "page_places": _PLACED,
    "search_match_all": "SELECT * FROM documents",
    "search_term": "SELECT * FROM documents WHERE lang = 'en'",
    "search_range": "SELECT * FROM documents WHERE n_chars >= 300 AND n_chars < 5000",
    "search_bool": """
        SELECT * FROM documents WHERE n_chars > 200 AND lang <> 'de' AND source IN ('src1', 'src2', 'src3')
    """,
    "search_prefix": "SELECT * FROM documents WHERE source LIKE 'src1%'",
    "search_wildcard": "SELECT * FROM documents WHERE regexp_full_match(source, 's.c.*2')",
    "search_ids": "SELECT * FROM documents WHERE doc_id IN (0, 5, 17, 40, 160, 99999999)",
    "search_match": f"SELECT * FROM documents WHERE list_has_any({_WORDS}, ['worthless', 'oredat'])",
    "search_match_all_words": f"SELECT * FROM documents WHERE list_has_all({_WORDS}, ['the', 'and', 'of'])",
    "search_match_phrase": f"SELECT * FROM documents WHERE contains(concat(' ', array_to_string({_WORDS}, ' '), ' '), ' with by ')",
    "search_size": "SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 25",
    "search_sort": "SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents",
    "search_source_project": """
        SELECT doc_id, CAST(NULL AS VARCHAR) AS text, lang, CAST(NULL AS VARCHAR) AS source, n_chars FROM documents
    """,
    "index_match_bool": f"""
        WITH d AS (SELECT *, {_WORDS} AS words FROM documents)
        SELECT * EXCLUDE (words) FROM d
        WHERE list_has_all(words, ['the', 'of']) AND NOT list_has_any(words, ['idiot'])
          AND (contains(concat(' ', array_to_string(words, ' '), ' '), ' with by ') OR list_has_any(words, ['worthless']) OR source = 'src1')
    """,
}
for _name in ("match", "match_all_words", "match_phrase"):
    ORACLE[f"index_{_name}"] = ORACLE[f"search_{_name}"]
