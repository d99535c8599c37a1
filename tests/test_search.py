from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.errors import InvalidRequest, NoData
from weirgate.operators import ranking, search

CITIES = [
    ("Tokyo", "Japan", 13960000, 35.6762, 139.6503),
    ("London", "United Kingdom", 8982000, 51.5074, -0.1278),
    ("Paris", "France", 2161000, 48.8566, 2.3522),
    ("New York", "United States", 8336000, 40.7128, -74.006),
    ("Berlin", "Germany", 3645000, 52.52, 13.405),
]
MAPPING = {
    "cities": {
        "mappings": {
            "properties": {
                "name": {"type": "keyword"},
                "country": {"type": "keyword"},
                "population": {"type": "integer"},
                "location": {"type": "geo_point"},
                "description": {"type": "text"},
            }
        }
    }
}


@pytest.fixture(scope="module")
def cities(spark):
    docs = [
        (json.dumps({"name": n, "country": c, "population": p, "location": {"lat": lat, "lon": lon}}),)
        for n, c, p, lat, lon in CITIES
    ]
    return search.documents(spark.createDataFrame(docs, "doc string"), "doc", MAPPING)


def names(df):
    return [r["name"] for r in df.collect()]


def test_match_all(cities):
    out = search.search(cities, {"query": {"match_all": {}}, "_source": ["name", "country", "population"]}, "name")
    assert set(names(out)) == {c[0] for c in CITIES}
    assert out.columns == ["name", "country", "population", "location", "description"]
    assert {r["location"] for r in out.collect()} == {None}


def test_geo_point_is_json_text(cities):
    row = search.search(cities, {"query": {"term": {"country": "Japan"}}}, "name").first()
    assert json.loads(row["location"]) == {"lat": 35.6762, "lon": 139.6503}
    assert (row["name"], row["population"]) == ("Tokyo", 13960000)


def test_range(cities):
    out = search.search(cities, {"query": {"range": {"population": {"gte": 8000000}}}}, "name")
    assert set(names(out)) == {"Tokyo", "London", "New York"}


def test_size_and_sort(cities):
    assert len(names(search.search(cities, {"size": 2}, "name"))) == 2
    assert names(search.search(cities, {"size": 0}, "name")) == []
    body = {"sort": [{"population": "desc"}], "size": 3}
    assert names(search.search(cities, body, "name")) == ["Tokyo", "London", "New York"]
    assert names(search.search(cities, {"sort": "population"}, "name"))[0] == "Paris"


def test_bool(cities):
    query = {"bool": {"must_not": {"exists": {"field": "description"}}, "should": [{"term": {"name": "Paris"}}, {"term": {"name": "Berlin"}}]}}
    assert set(names(search.search(cities, {"query": query}, "name"))) == {"Paris", "Berlin"}
    # a missing value does not match, so must_not lets it through
    query = {"bool": {"must_not": [{"term": {"description": "x"}}], "filter": {"terms": {"name": ["Paris", "Oslo"]}}}}
    assert names(search.search(cities, {"query": query}, "name")) == ["Paris"]
    query = {"bool": {"should": [{"term": {"name": "Paris"}}, {"range": {"population": {"lt": 3000000}}}, {"match_all": {}}], "minimum_should_match": 3}}
    assert names(search.search(cities, {"query": query}, "name")) == ["Paris"]


@pytest.mark.parametrize(
    "body",
    [
        "not json", "[]", '{"_source": false}', '{"query": {"fuzzy": {"a": "b"}}}', '{"query": {"range": {"name": {"above": 1}}}}',
        '{"sort": [{"name": "up"}]}',
    ],
)
def test_bad_requests(cities, body):
    with pytest.raises(InvalidRequest):
        search.search(cities, body, "name")


def test_index_of_a_request():
    request = search.parse_search('{"index": "cities", "query": {"match_all": {}}, "size": 10}')
    assert (request.index, request.size) == ("cities", 10)
    assert search.resolve_default_index(request.index, {"index": "other"}) == "cities"
    assert search.resolve_default_index(None, {"index": "other"}) == "other"
    with pytest.raises(InvalidRequest):
        search.resolve_default_index(None, {})


def test_default_index_column(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) i, map('x', 'y') p")
    with pytest.raises(Exception, match="without an index"):
        df.select(search.default_index_column(F.col("i"), F.col("p"))).collect()


def test_mapping():
    nested = {"i": {"mappings": {"properties": {"user": {"properties": {"name": {"type": "keyword"}, "age": {"type": "integer"}}}}}}}
    assert search.parse_mapping(nested) == [("user.name", "keyword"), ("user.age", "integer")]
    two = {
        "a": {"mappings": {"properties": {"x": {"type": "integer"}, "y": {"type": "keyword"}}}},
        "b": {"mappings": {"properties": {"x": {"type": "keyword"}, "z": {"type": "date"}}}},
    }
    assert search.parse_mapping(two) == [("x", "text"), ("y", "keyword"), ("z", "date")]
    assert search.parse_mapping({"mappings": {"properties": {"x": {"type": "long"}}}}) == [("x", "long")]
    assert search.parse_mapping({"a": {"mappings": {}}}) == []


def test_mapping_schema(spark):
    schema = search.mapping_to_schema([("user.name", "keyword"), ("n", "byte"), ("t", "date")])
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields] == [
        ("user.name", "string", True), ("n", "tinyint", True), ("t", "timestamp", True),
    ]
    with pytest.raises(NoData):
        search.mapping_to_schema([])


def test_sort_keys():
    assert search.sort_keys((), "id") == [("id", "asc", "_last")]
    assert search.sort_keys((("n", "desc", "_last"),), "id")[1] == ("id", "asc", "_last")
    assert search.sort_keys((("_shard_doc", "desc", "_last"),), "id") == [("id", "desc", "_last")]
    assert search.sort_keys((("id", "desc", "_last"), ("n", "asc", "_last")), "id")[0][0] == "id"


def test_merge_schemas(spark):
    a = spark.sql("SELECT 1 x, 'a' y, named_struct('k', 1L) o")
    b = spark.sql("SELECT 'q' x, 2.5D z")
    merged = search.merge_schemas([a, b])
    assert [(f.name, f.dataType) for f in merged.schema.fields] == [
        ("x", T.StringType()), ("y", T.StringType()), ("o.k", T.LongType()), ("z", T.DoubleType()),
    ]
    assert {tuple(r) for r in merged.collect()} == {("1", "a", 1, None), ("q", None, None, 2.5)}


@pytest.mark.parametrize("sort", [(("v", "asc", "_last"),), (("v", "desc", "_last"), ("w", "asc", "_first")), (("v", "asc", "_first"),), ()])
def test_pages_make_up_the_full_sort(spark, sort):
    rows = [(i, None if i % 5 == 0 else i % 7, None if i % 3 == 0 else i % 2) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, v int, w int")
    keys = search.sort_keys(sort, "id")
    whole = [r["id"] for r in df.orderBy(*search.ordering(df, keys)).collect()]
    got, after = [], None
    while True:
        page = search.page_after(df, sort, "id", after, 10).collect()
        got += [r["id"] for r in page]
        if len(page) < 10:
            break
        after = search.next_key(page[-1], sort, "id")
    assert got == whole


def test_page_filter_is_pushed_down(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = search.page_after(orders, (("o_orderdate", "desc", "_last"),), "o_orderkey", None, 10).collect()
    after = search.next_key(first[-1], (("o_orderdate", "desc", "_last"),), "o_orderkey")
    page = search.page_after(orders, (("o_orderdate", "desc", "_last"),), "o_orderkey", after, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("]")[0]
    assert "LessThanOrEqual(o_orderdate" in pushed
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(("offset", "limit"), [(0, 1), (0, 500), (37, 100), (990, 50), (1000, 5), (0, 5000), (5, 0)])
def test_large_cuts_are_exact(spark, monkeypatch, offset, limit):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    monkeypatch.setattr(ranking, "TOP_ROWS", 0)
    got = [r["k"] for r in ranking.take_ordered(df, [F.col("k").asc()], limit, offset).collect()]
    assert got == list(range(1000))[offset : offset + limit]


def test_places_are_exact(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ranking.with_place(df, [F.col("k").desc()]).collect()
    assert {(r["k"], r["place"]) for r in got} == {(999 - i, i + 1) for i in range(1000)}
    assert ranking.with_place(df.limit(0), [F.col("k").asc()]).count() == 0


@pytest.mark.parametrize("size", [0, 1, 7, 25, 150, 300])
def test_late_reading_gives_the_same_rows(spark, sf_dir, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = {"query": {"term": {"lang": "en"}}, "sort": [{"n_chars": "desc"}], "size": size}
    want = search.search(docs, body, "doc_id").collect()
    assert search.search(docs, body, "doc_id", late=True).collect() == want


def test_late_keys_reach_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = search.search(docs, {"size": 15, "sort": [{"n_chars": "desc"}]}, "doc_id", late=True)
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("ReadSchema")[0]
    assert pushed.count("In(doc_id") == 2


def test_lists_and_maps_come_as_text(spark):
    df = spark.sql("SELECT 1 id, array('a', 'b') tags, map('k', CAST(NULL AS INT)) m, named_struct('x', array(1)) o, parse_json('{\"q\":[1]}') v")
    out = search.search(df, {"query": {"term": {"tags": "b"}}}, "id")
    assert tuple(out.first()) == (1, '["a","b"]', '{"k":null}', "[1]", '{"q":[1]}')
    assert out.columns == ["id", "tags", "m", "o.x", "v"]
    less = search.search(df, {"_source": ["o"]}, "id")
    assert less.dtypes == out.dtypes and tuple(less.first()) == (None, None, None, "[1]", None)


def test_terms(spark):
    df = spark.sql("SELECT id, array(concat('t', id), 'x') tags FROM range(4)")

    def ids(path, values):
        return sorted(r["id"] for r in search.search(df, {"query": {"terms": {path: values}}}, "id").collect())

    assert ids("id", [1, 3, 9]) == [1, 3]
    assert ids("tags", ["t0", "t2"]) == [0, 2]
    assert ids("tags", ["x"]) == [0, 1, 2, 3]
    assert ids("id", []) == [] and ids("tags", []) == []


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ({"prefix": {"t": "The"}}, [1]),
        ({"prefix": {"tags": {"value": "re"}}}, [2]),
        ({"wildcard": {"t": "*d?g*"}}, [1]),
        ({"wildcard": {"t": r"100\%*"}}, []),
        ({"wildcard": {"t": r"a\*?"}}, [3]),
        ({"match": {"t": "DOG, lazy"}}, [1, 2]),
        ({"match": {"t": {"query": "dog lazy", "operator": "and"}}}, [1]),
        ({"match": {"t": "..."}}, []),
        ({"match_phrase": {"t": "lazy dog"}}, [1]),
        ({"match_phrase": {"t": "dog lazy"}}, []),
        ({"ids": {"values": [2, 3, 9]}}, [2, 3]),
        ({"bool": {"must_not": [{"match": {"t": "dog"}}, {"ids": {"values": [3]}}]}}, [2, 4]),
    ],
)
def test_text_clauses(spark, query, found):
    rows = [(1, "The lazy, Dog's dig", ["a"]), (2, "so lazy", ["red", None]), (3, "a*b", []), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, t string, tags array<string>")
    assert sorted(r["id"] for r in search.search(df, {"query": query}, "id").collect()) == found


def test_text_clause_settings(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    for query in ({"match": {"t": {"query": "a", "boost": 2}}}, {"match": {"t": {"query": "a", "operator": "x"}}}, {"prefix": {"t": {}}}):
        with pytest.raises(search.InvalidRequest):
            search.search(df, {"query": query}, "id")
