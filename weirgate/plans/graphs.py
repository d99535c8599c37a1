"""Graph patterns over nodes and edges made of customers, nations, regions and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext
from ..operators import graph
from ..operators.ranking import with_place
from .tables import table

# Ids of the four kinds of nodes do not meet: regions and nations are small, the others alternate.
PROPERTIES = "struct<balance: double, name: string, price: double, segment: string>"


def _node(node_id: Column, label: str, **properties: Column) -> list[Column]:
    have = {"balance": "double", "name": "string", "price": "double", "segment": "string"}
    fields = [properties.get(n, F.lit(None)).cast(t).alias(n) for n, t in have.items()]
    return [node_id.cast("bigint").alias("id"), F.array(F.lit(label)).alias("labels"), F.struct(*fields).alias("properties")]


def customer_id(key: str) -> Column:
    return F.col(key) * 2 + 10_000


def order_id(key: str) -> Column:
    return F.col(key) * 2 + 10_001


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders"))
    parts = [
        region.select(*_node(F.col("r_regionkey"), "Region", name=F.col("r_name"))),
        nation.select(*_node(F.col("n_nationkey") + 100, "Nation", name=F.col("n_name"))),
        customer.select(
            *_node(
                customer_id("c_custkey"), "Customer",
                name=F.col("c_name"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"),
            )
        ),
        orders.select(*_node(order_id("o_orderkey"), "Order", price=F.col("o_totalprice"))),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, orders = (table(spark, sf_dir, n) for n in ("customer", "nation", "orders"))

    def edge(edge_id: Column, src: Column, dst: Column, typ: str, price: Column) -> list[Column]:
        return [
            edge_id.cast("bigint").alias("id"),
            src.cast("bigint").alias("src"),
            dst.cast("bigint").alias("dst"),
            F.lit(typ).alias("typ"),
            F.struct(price.cast("double").alias("price")).alias("properties"),
        ]

    lives = customer.select(
        *edge(F.col("c_custkey") * 3, customer_id("c_custkey"), F.col("c_nationkey") + 100, "LIVES_IN", F.lit(None))
    )
    part_of = nation.select(
        *edge(F.col("n_nationkey") * 3 + 1, F.col("n_nationkey") + 100, F.col("n_regionkey"), "PART_OF", F.lit(None))
    )
    placed = orders.select(
        *edge(F.col("o_orderkey") * 3 + 2, customer_id("o_custkey"), order_id("o_orderkey"), "PLACED", F.col("o_totalprice"))
    )
    return lives.unionByName(part_of).unionByName(placed)


def graph_match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    returning = {"id": "n.id", "name": "n.properties.name", "segment": "n.properties.segment"}
    return graph.match_nodes(nodes(spark, sf_dir), "Customer", returning, order_by=["name"])


def graph_filter_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    returning = {"name": "n.properties.name", "balance": "n.properties.balance"}
    return graph.match_nodes(nodes(spark, sf_dir), "Customer", returning, "n.properties.segment = 'BUILDING'")


def graph_match_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    returning = {"customer": "a.properties.name", "nation": "b.properties.name"}
    return graph.match_edge(nodes(spark, sf_dir), edges(spark, sf_dir), "LIVES_IN", returning, "Customer", "Nation")


def graph_edge_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    returning = {"customer": "a.properties.name", "order_node": "b.id", "price": "r.properties.price"}
    found = graph.match_edge(
        nodes(spark, sf_dir), edges(spark, sf_dir), "PLACED", returning, "Customer", "Order", order_by=["price", "order_node"]
    )
    return with_place(found, [F.col("price").asc(), F.col("order_node").asc()])


def graph_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    returning = {"id": "n.id", "name": "n.properties.name"}
    return graph.match_nodes(nodes(spark, sf_dir), "Customer", returning, order_by=["-id"], limit=20)


def node_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = nodes(spark, sf_dir)
    return graph.match_nodes(every, "Customer", {"id": "n.id", "node": graph.node_json(every)})


def edge_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = edges(spark, sf_dir)
    packed = every.select(F.struct("*").alias("r")).where("r.typ = 'PLACED'")
    return packed.select(
        F.col("r.id").alias("id"),
        graph.edge_json(every).alias("edge"),
        graph.edge_json(every, unbound=True).alias("unbound"),
    )


def path_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> nation -> region, with the path as JSON text."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    hops = [graph.Hop("LIVES_IN", "Nation"), graph.Hop("PART_OF", "Region")]
    path = graph.path_json(n, e, 2)
    node_ids = F.from_json(path, "nodes array<struct<id: bigint>>, relationships array<struct<typ: string>>")
    returning = {
        "customer": "n0.id",
        "region": "n2.properties.name",
        "ids": F.array_join(node_ids.getField("nodes").getField("id").cast("array<string>"), ">"),
        "types": F.array_join(node_ids.getField("relationships").getField("typ"), ">"),
        "n_chars": F.length(path),
    }
    return graph.match_path(n, e, "Customer", hops, returning)


def collection_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(F.col("o_orderkey"), F.col("o_custkey"), F.lit(None)).alias("list"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("empty"), F.lit(None)).alias("map"),
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "o_orderkey", *[jsontext.collection_to_json(F.col(c), kinds[c]).alias(c) for c in ("list", "map")]
    )


def point_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("c_nationkey").cast("double") + 0.5, F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        jsontext.point_to_json(F.lit(4326), x, y).alias("flat"),
        jsontext.point_to_json(F.lit(4979), x, y, F.lit(1.5)).alias("space"),
    )


def temporal_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    whole = F.date_trunc("SECOND", "ts").cast("timestamp_ntz")
    return events.select(
        "event_id",
        jsontext.temporal_text(F.col("ts").cast("date"), T.DateType()).alias("day"),
        jsontext.temporal_text(F.col("ts"), T.TimestampNTZType()).alias("local"),
        jsontext.temporal_text(whole, T.TimestampNTZType()).alias("local_second"),
    )


def first_row_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose ``v`` changes its kind with the event type, typed by the first error event."""
    events = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.col("value").alias("x")))).otherwise(
        F.col("user_id").cast("string")
    )
    doc = F.concat(F.lit('{"k":'), F.col("event_id"), F.lit(',"p":'), F.col("props"), F.lit(',"v":'), v, F.lit("}"))
    position = F.when(F.col("event_type") == "error", 0).otherwise(1_000_000_000_000) + F.col("event_id")
    return graph.first_row_schema(events.select(position.alias("position"), doc.alias("doc")), "doc", "position")


QUERIES = {
    "graph_match_nodes": graph_match_nodes,
    "graph_filter_property": graph_filter_property,
    "graph_match_edge": graph_match_edge,
    "graph_edge_properties": graph_edge_properties,
    "graph_limit": graph_limit,
    "node_to_json": node_to_json,
    "edge_to_json": edge_to_json,
    "path_to_json": path_to_json,
    "collection_to_json": collection_to_json,
    "point_to_json": point_to_json,
    "temporal_to_text": temporal_to_text,
    "first_row_schema": first_row_schema,
}
ORACLE = {
    "graph_match_nodes": "SELECT c_custkey * 2 + 10000 AS id, c_name AS name, c_mktsegment AS segment FROM customer",
    "graph_filter_property": "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'",
    "graph_match_edge": """
        SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "graph_edge_properties": """
        SELECT c_name AS customer, o_orderkey * 2 + 10001 AS order_node, o_totalprice AS price,
               row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place
        FROM orders JOIN customer ON o_custkey = c_custkey
    """,
    "graph_limit": """
        SELECT c_custkey * 2 + 10000 AS id, c_name AS name FROM customer ORDER BY c_custkey DESC LIMIT 20
    """,
    "node_to_json": """
        SELECT c_custkey * 2 + 10000 AS id,
               concat('{"id":', c_custkey * 2 + 10000, ',"labels":["Customer"],"properties":{"balance":', c_acctbal,
                      ',"name":"', c_name, '","price":null,"segment":"', c_mktsegment, '"}}') AS node
        FROM customer
    """,
    "edge_to_json": """
        SELECT o_orderkey * 3 + 2 AS id,
               concat('{"end_node_id":', o_orderkey * 2 + 10001, ',"id":', o_orderkey * 3 + 2, ',"properties":{"price":',
                      o_totalprice, '},"start_node_id":', o_custkey * 2 + 10000, ',"typ":"PLACED"}') AS edge,
               concat('{"id":', o_orderkey * 3 + 2, ',"properties":{"price":', o_totalprice, '},"typ":"PLACED"}') AS unbound
        FROM orders
    """,
    "path_to_json": """
        SELECT c_custkey * 2 + 10000 AS customer, r_name AS region,
               concat(c_custkey * 2 + 10000, '>', n_nationkey + 100, '>', r_regionkey) AS ids, 'LIVES_IN>PART_OF' AS types,
               CAST(length(concat(
                 '{"nodes":[{"id":', c_custkey * 2 + 10000, ',"labels":["Customer"],"properties":{"balance":', c_acctbal,
                 ',"name":"', c_name, '","price":null,"segment":"', c_mktsegment,
                 '"}},{"id":', n_nationkey + 100, ',"labels":["Nation"],"properties":{"balance":null,"name":"', n_name,
                 '","price":null,"segment":null}},{"id":', r_regionkey,
                 ',"labels":["Region"],"properties":{"balance":null,"name":"', r_name,
                 '","price":null,"segment":null}}],"relationships":[{"id":', c_custkey * 3,
                 ',"properties":{"price":null},"typ":"LIVES_IN"},{"id":', n_nationkey * 3 + 1,
                 ',"properties":{"price":null},"typ":"PART_OF"}]}')) AS INT) AS n_chars
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
    "collection_to_json": """
        SELECT o_orderkey, concat('[', o_orderkey, ',', o_custkey, ',null]') AS list,
               concat('{"empty":null,"status":"', o_orderstatus, '"}') AS map
        FROM orders
    """,
    "point_to_json": """
        SELECT c_custkey,
               concat('{"srid":4326,"x":', c_nationkey + 0.5, ',"y":', CAST(c_custkey AS DOUBLE), '}') AS flat,
               concat('{"srid":4979,"x":', c_nationkey + 0.5, ',"y":', CAST(c_custkey AS DOUBLE), ',"z":1.5}') AS space
        FROM customer
    """,
    "temporal_to_text": """
        SELECT event_id, strftime(ts, '%Y-%m-%d') AS day,
               CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                    WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS local,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS local_second
        FROM events
    """,
    "first_row_schema": """
        SELECT event_id + CASE WHEN event_type = 'error' THEN 0 ELSE 1000000000000 END AS position, event_id AS k,
               replace(props, ' ', '') AS p,
               CASE WHEN event_type = 'error' THEN concat('{"x":', value, '}') ELSE CAST(user_id AS VARCHAR) END AS v
        FROM events
    """,
}
