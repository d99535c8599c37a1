from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weirgate.functions import jsontext
from weirgate.operators import graph

PROPS = "struct<name: string, country: string, population: bigint, age: bigint>"
CITIES = {"Tokyo": ("Japan", 13960000), "London": ("United Kingdom", 8982000), "Paris": ("France", 2161000), "New York": ("United States", 8336000), "Berlin": ("Germany", 3645000)}
PERSONS = {"Alice": 30, "Bob": 25, "Carol": 35}
IDS = {name: i for i, name in enumerate([*CITIES, *PERSONS])}
FLIGHTS = [("Tokyo", "London", 9571), ("London", "Paris", 344), ("Paris", "New York", 5837), ("New York", "Berlin", 6385), ("Berlin", "Tokyo", 8918)]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(IDS[n], ["City"], (n, c, p, None)) for n, (c, p) in CITIES.items()]
    rows += [(IDS[n], ["Person"], (n, None, None, a)) for n, a in PERSONS.items()]
    return spark.createDataFrame(rows, f"id long, labels array<string>, properties {PROPS}")


@pytest.fixture(scope="module")
def edges(spark):
    ends = [("Alice", "Tokyo", "LIVES_IN", None), ("Bob", "London", "LIVES_IN", None), ("Carol", "Paris", "LIVES_IN", None)]
    ends += [("Alice", "Bob", "KNOWS", None), ("Bob", "Carol", "KNOWS", None)]
    ends += [(a, b, "FLIGHT_TO", km) for a, b, km in FLIGHTS]
    rows = [(100 + i, IDS[a], IDS[b], typ, (km,)) for i, (a, b, typ, km) in enumerate(ends)]
    return spark.createDataFrame(rows, "id long, src long, dst long, typ string, properties struct<distance_km: bigint>")


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_nodes(nodes):
    out = graph.match_nodes(nodes, "City", {"name": "n.properties.name"}, order_by=["name"])
    assert pairs(out) == [("Berlin",), ("London",), ("New York",), ("Paris",), ("Tokyo",)]
    out = graph.match_nodes(nodes, "City", {"name": "n.properties.name", "p": "n.properties.population"}, "n.properties.country = 'Japan'")
    assert pairs(out) == [("Tokyo", 13960000)]
    out = graph.match_nodes(nodes, "Person", {"name": "n.properties.name", "age": "n.properties.age"}, order_by=["name"])
    assert pairs(out) == [("Alice", 30), ("Bob", 25), ("Carol", 35)]
    assert graph.match_nodes(nodes, "City", {"name": "n.properties.name"}, limit=2).count() == 2


def test_edges(nodes, edges):
    out = graph.match_edge(nodes, edges, "LIVES_IN", {"p": "a.properties.name", "c": "b.properties.name"}, "Person", "City", order_by=["p"])
    assert pairs(out) == [("Alice", "Tokyo"), ("Bob", "London"), ("Carol", "Paris")]
    out = graph.match_edge(
        nodes, edges, "FLIGHT_TO",
        {"origin": "a.properties.name", "destination": "b.properties.name", "km": "r.properties.distance_km"}, "City", order_by=["km"],
    )
    got = pairs(out)
    assert got[0] == ("London", "Paris", 344)
    assert got == sorted(FLIGHTS, key=lambda f: f[2])


def test_two_hops_and_direction(nodes, edges):
    hops = [graph.Hop("KNOWS", "Person"), graph.Hop("LIVES_IN", "City")]
    out = graph.match_path(nodes, edges, "Person", hops, {"a": "n0.properties.name", "c": "n2.properties.name"}, order_by=["a"])
    assert pairs(out) == [("Alice", "London"), ("Bob", "Paris")]
    out = graph.match_path(nodes, edges, "City", [graph.Hop("LIVES_IN", "Person", incoming=True)], {"c": "n0.properties.name", "p": "n1.properties.name"}, "n0.properties.name = 'Paris'")
    assert pairs(out) == [("Paris", "Carol")]


def test_whole_values(nodes, edges):
    out = graph.match_nodes(nodes, "Person", {"p": graph.node_json(nodes)}, "n.properties.name = 'Alice'")
    node = json.loads(out.first()["p"])
    assert node == {"id": IDS["Alice"], "labels": ["Person"], "properties": {"name": "Alice", "age": 30, "country": None, "population": None}}
    hops = [graph.Hop("KNOWS"), graph.Hop("LIVES_IN")]
    out = graph.match_path(nodes, edges, None, hops, {"path": graph.path_json(nodes, edges, 2), "e": graph.edge_json(edges, "e1"), "u": graph.edge_json(edges, "e1", unbound=True)}, "n0.properties.name = 'Alice'")
    row = out.first()
    path = json.loads(row["path"])
    assert [n["properties"]["name"] for n in path["nodes"]] == ["Alice", "Bob", "London"]
    assert path["relationships"][0] == {"id": 103, "typ": "KNOWS", "properties": {"distance_km": None}}
    assert json.loads(row["u"]) == path["relationships"][0]
    assert json.loads(row["e"]) == path["relationships"][0] | {"start_node_id": IDS["Alice"], "end_node_id": IDS["Bob"]}


def test_points_and_lists(spark):
    one = spark.range(1)
    assert json.loads(one.select(jsontext.point_to_json(F.lit(4326), F.lit(1.5), F.lit(2.5))).first()[0]) == {"srid": 4326, "x": 1.5, "y": 2.5}
    assert json.loads(one.select(jsontext.point_to_json(F.lit(1), F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()[0])["z"] == 3.0
    df = spark.sql("SELECT array(1, 2) l, map('b', 1, 'a', CAST(NULL AS INT)) m, array(DATE'2020-02-03') d")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[jsontext.collection_to_json(F.col(c), kinds[c]) for c in df.columns]).first()
    assert tuple(got) == ("[1,2]", '{"a":null,"b":1}', '["2020-02-03"]')


def test_times_as_text(spark):
    df = spark.sql(
        """SELECT DATE'2023-11-14' a, TIMESTAMP'2023-11-14 22:13:20Z' b, TIMESTAMP'2023-11-14 22:13:20.5Z' c,
                  TIMESTAMP_NTZ'2023-11-14 22:13:20' d, TIMESTAMP_NTZ'2023-11-14 22:13:20.000125' e,
                  INTERVAL '1 02:03:04.5' DAY TO SECOND f, X'0102' g"""
    )
    kinds = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[jsontext.json_ready(F.col(c), kinds[c]) for c in df.columns]).first()
    assert tuple(got) == (
        "2023-11-14", "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.500+00:00", "2023-11-14 22:13:20",
        "2023-11-14 22:13:20.000125", "PT93784.5S", "AQI=",
    )


def test_first_row_decides(spark):
    rows = [
        (1, '{"n":1,"x":1.5,"s":"a","b":true,"o":{"k":1},"z":null}'),
        (2, '{"n":"2","x":2,"s":5,"b":null,"o":[1],"z":{"q":1}}'),
        (3, '{"n":3,"s":null,"z":"t"}'),
    ]
    df = spark.createDataFrame(rows, "pos int, doc string").repartition(3)
    out = graph.first_row_schema(df, "doc", "pos")
    assert out.schema.simpleString() == "struct<pos:int,b:boolean,n:bigint,o:string,s:string,x:double,z:string>"
    assert pairs(out.orderBy("pos")) == [
        (1, True, 1, '{"k":1}', "a", 1.5, None), (2, None, None, "[1]", "5", None, '{"q":1}'), (3, None, 3, None, None, None, "t"),
    ]
    assert graph.first_row_schema(df.where("pos > 9"), "doc", "pos").columns == []


