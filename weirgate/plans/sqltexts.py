"""Free SQL text over the registered tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.sqltext import register_tables, sql_read
from .tables import NAMES, location

# Text that both engines read the same way.
SHARED = {
    "sql_filter_project": """
        SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate
        FROM lineitem
        WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01'
          AND l_quantity < 24 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'F'
    """,
    "sql_join": """
        SELECT n.n_name, r.r_name, o.o_orderpriority, count(*) AS n_lines,
               CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l.l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
        GROUP BY n.n_name, r.r_name, o.o_orderpriority
    """,
    "sql_semi_anti": """
        SELECT c.c_custkey, c.c_name, 'finished' AS kind FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
          AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
        UNION ALL
        SELECT s.s_suppkey, s.s_name, 'idle' AS kind FROM supplier s
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)
    """,
    "sql_range_join": """
        SELECT o.o_orderkey, l.l_partkey, l.l_linenumber, l.l_quantity, o.o_orderdate, l.l_shipdate
        FROM orders o JOIN lineitem l
          ON l.l_orderkey = o.o_orderkey
         AND l.l_shipdate > o.o_orderdate
         AND l.l_shipdate <= o.o_orderdate + INTERVAL '365' DAY
    """,
    "sql_aggregate": """
        SELECT l_returnflag, l_linestatus, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers,
               CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
               min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
               count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted
        FROM lineitem
        GROUP BY l_returnflag, l_linestatus
        HAVING count(*) > 10
    """,
    "sql_rollup": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
               CAST(grouping(o_orderstatus) AS INT) AS all_status, CAST(grouping(o_orderpriority) AS INT) AS all_priority
        FROM orders
        GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())
    """,
    "sql_window": """
        SELECT event_id, user_id, event_type, value,
               CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS place,
               lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS previous,
               CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (
                 PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three
        FROM events
    """,
    "sql_topk": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5
    """,
    "sql_setops": """
        (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
        UNION
        (SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    """,
    "sql_cte": """
        WITH spent AS (
          SELECT c.c_custkey, c.c_nationkey, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
          FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_nationkey
        ), best AS (SELECT c_nationkey, max(total) AS top FROM spent GROUP BY c_nationkey)
        SELECT s.c_custkey, s.c_nationkey, s.total,
               (SELECT max(top) FROM best) AS overall
        FROM spent s JOIN best b ON s.c_nationkey = b.c_nationkey AND s.total = b.top
    """,
    "sql_recursive": """
        WITH RECURSIVE years(y) AS (
          SELECT min(CAST(extract(YEAR FROM o_orderdate) AS INT)) FROM orders
          UNION ALL
          SELECT y + 1 FROM years WHERE y < 2010
        ), counted AS (
          SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1
        )
        SELECT years.y, coalesce(counted.n, 0) AS n_orders FROM years LEFT JOIN counted ON counted.y = years.y
    """,
}

SCALAR = """
    SELECT o_orderkey, upper(substring(o_orderpriority, 3, 20)) AS priority, length(o_orderpriority) AS n_chars,
           concat(o_orderstatus, '-', CAST(o_custkey AS STRING)) AS tag,
           round(o_totalprice / 1000, 1) AS thousands, abs(50000 - floor(o_totalprice)) AS gap,
           CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m,
           datediff(DATE '2005-01-01', o_orderdate) AS age_days,
           CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size, nullif(o_orderstatus, 'P') AS status,
           size(split(o_orderpriority, '-')) AS n_parts, element_at(map('O', 1, 'F', 2, 'P', 3), o_orderstatus) AS code,
           array_contains(array('O', 'F'), o_orderstatus) AS is_known,
           CAST(get_json_object(to_json(named_struct('a', named_struct('b', o_custkey))), '$.a.b') AS BIGINT) AS via_json
    FROM orders
"""
SCALAR_ORACLE = """
    SELECT o_orderkey, upper(substring(o_orderpriority, 3, 20)) AS priority, CAST(length(o_orderpriority) AS INT) AS n_chars,
           concat(o_orderstatus, '-', CAST(o_custkey AS VARCHAR)) AS tag,
           round(o_totalprice / 1000, 1) AS thousands, CAST(abs(50000 - floor(o_totalprice)) AS BIGINT) AS gap,
           CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2005-01-01') AS INT) AS age_days,
           CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size, nullif(o_orderstatus, 'P') AS status,
           CAST(len(string_split(o_orderpriority, '-')) AS INT) AS n_parts,
           CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END AS INT) AS code,
           o_orderstatus IN ('O', 'F') AS is_known,
           o_custkey AS via_json
    FROM orders
"""
PARAMS = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high
"""
PARAMS_ORACLE = PARAMS.replace(":status", "'O'").replace(":low", "100000.0").replace(":high", "200000.0")


def _query(text: str, args: Mapping[str, Any] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [name for name in NAMES if re.search(rf"\b(FROM|JOIN) {name}\b", text)]
        register_tables(spark, location(sf_dir), used)
        return sql_read(spark, text, args)

    return run


QUERIES = {name: _query(text) for name, text in SHARED.items()} | {
    "sql_scalar": _query(SCALAR),
    "sql_params": _query(PARAMS, {"status": "O", "low": 100000.0, "high": 200000.0}),
}
ORACLE = SHARED | {"sql_scalar": SCALAR_ORACLE, "sql_params": PARAMS_ORACLE}
