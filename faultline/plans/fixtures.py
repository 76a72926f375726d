"""Views of the driver's tables that exercise the operators. The same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NODES = """
SELECT concat('r', r_regionkey) AS key, 'Module' AS kind, r_name AS name, concat('world.', r_name) AS qualified_name,
       concat('region/', r_regionkey) AS module_path, 1 AS start_line, 1 AS end_line, CAST(0 AS DOUBLE) AS composite,
       CAST(0 AS DOUBLE) AS churn, CAST(0 AS DOUBLE) AS bug_density, CAST(NULL AS STRING) AS route_path, CAST(NULL AS STRING) AS doc FROM region
UNION ALL
SELECT concat('n', n_nationkey), 'Class', n_name, concat('nation.', n_name), concat('region/', n_regionkey), n_nationkey + 1, n_nationkey + 1,
       CAST(n_nationkey AS DOUBLE) / 25, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM nation
UNION ALL
SELECT concat('c', c_custkey), 'Function', c_name, concat('customer.', c_mktsegment, '.', c_name), concat('nation/', c_nationkey), CAST(c_custkey AS INT), CAST(c_custkey AS INT),
       CAST(c_custkey % 10 AS DOUBLE) / 10, CAST(c_custkey % 7 AS DOUBLE) / 7, CAST(c_custkey % 5 AS DOUBLE) / 5, CAST(NULL AS STRING), c_mktsegment FROM customer
UNION ALL
SELECT concat('s', s_suppkey), 'Method', s_name, concat('supplier.', s_name), concat('nation/', s_nationkey), CAST(s_suppkey AS INT), CAST(s_suppkey AS INT),
       CAST(s_suppkey % 10 AS DOUBLE) / 10, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM supplier
UNION ALL
SELECT concat('o', o_orderkey), 'Function', concat('order', o_orderkey), concat('orders.order', o_orderkey), concat('customer/', o_custkey),
       CAST(10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + 1 AS INT), CAST(10 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT),
       CAST(o_orderkey % 10 AS DOUBLE) / 10, CAST(o_orderkey % 7 AS DOUBLE) / 7, CAST(o_orderkey % 5 AS DOUBLE) / 5, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM orders
"""

EDGES = """
SELECT concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS dst, 'Imports' AS kind, CAST(0.95 AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'Imports', CAST(0.95 AS DOUBLE) FROM customer
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'Imports', CAST(0.95 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), 'Calls', CAST(0.95 AS DOUBLE) FROM orders
UNION ALL SELECT concat('o', l_orderkey), concat('s', l_suppkey), 'DbQuery', CAST(1 - l_discount AS DOUBLE) FROM lineitem
"""

#: A small cyclic graph with parallel edges, tests, co-change and an external package.
CYCLE_NODES = """
SELECT * FROM (VALUES
 ('a', 'Function', 'load', 'app.load', 'app/load.py', 1, 10, CAST(0.5 AS DOUBLE)), ('b', 'Function', 'parse', 'app.parse', 'app/parse.py', 1, 20, CAST(0.1 AS DOUBLE)),
 ('c', 'Method', 'Store.save', 'app.Store.save', 'app/store.py', 5, 9, CAST(0 AS DOUBLE)), ('d', 'Class', 'Store', 'app.Store', 'app/store.py', 1, 30, CAST(0.9 AS DOUBLE)),
 ('e', 'Function', 'main', 'app.main', 'app/main.py', 1, 5, CAST(0 AS DOUBLE)), ('t', 'Function', 'test_load', 'tests.test_load', 'tests/test_load.py', 1, 5, CAST(0 AS DOUBLE)),
 ('x', 'External', 'requests', 'requests', 'requests', 1, 1, CAST(0 AS DOUBLE)), ('xg', 'External', 'get', 'requests.get', 'requests', 1, 1, CAST(0 AS DOUBLE))
) AS v(key, kind, name, qualified_name, module_path, start_line, end_line, composite)
"""
CYCLE_EDGES = """
SELECT * FROM (VALUES
 ('a', 'b', 'Calls', CAST(0.95 AS DOUBLE)), ('b', 'c', 'Calls', CAST(0.9 AS DOUBLE)), ('b', 'c', 'References', CAST(0.8 AS DOUBLE)), ('c', 'a', 'Calls', CAST(0.6 AS DOUBLE)),
 ('c', 'd', 'References', CAST(0.9 AS DOUBLE)), ('e', 'a', 'Calls', CAST(0.95 AS DOUBLE)), ('e', 'd', 'Calls', CAST(0.45 AS DOUBLE)), ('t', 'a', 'Tests', CAST(0.76 AS DOUBLE)),
 ('a', 'x', 'Imports', CAST(0.95 AS DOUBLE)), ('a', 'xg', 'Calls', CAST(0.9 AS DOUBLE)), ('d', 'xg', 'References', CAST(0.9 AS DOUBLE)), ('b', 'd', 'ChangesWith', CAST(0.7 AS DOUBLE))
) AS v(src, dst, kind, confidence)
"""

COMMIT_FILES = """
SELECT DISTINCT concat(o_custkey, '-', year(o_orderdate)) AS commit, concat('c', o_custkey) AS author, concat('nation/', s_nationkey) AS file,
       dense_rank() OVER (ORDER BY year(o_orderdate) DESC, o_custkey) - 1 AS seq,
       max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, year(o_orderdate)) = 1 AS is_fix
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
"""

CHANGED = """
SELECT concat('customer/', o_custkey) AS module_path, start_line + 2 AS from_line, start_line + 5 AS to_line FROM (
  SELECT o_custkey, o_orderdate, CAST(10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + 1 AS INT) AS start_line FROM orders)
WHERE o_orderdate >= TIMESTAMP '2001-06-01 00:00:00'
"""

#: Text nodes: parts, with how often each is ordered as their in-edges.
TEXT_NODES = """
SELECT concat('p', p_partkey) AS key, p_name AS name, concat(p_brand, '.', p_name) AS qualified_name, p_type AS module_path, p_brand AS doc,
       CAST(NULL AS STRING) AS route_path, CAST(p_size AS DOUBLE) / 100 AS composite FROM part
"""
TEXT_EDGES = "SELECT concat('o', l_orderkey) AS src, concat('p', l_partkey) AS dst, 'Calls' AS kind, CAST(1 AS DOUBLE) AS confidence FROM lineitem"

ROUTE_CONSUMERS = """
SELECT page_id AS id, 'Http' AS transport, 'GET' AS method, concat('page', page_id) AS key,
       regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS raw FROM pages
"""
ROUTE_PRODUCERS = """
SELECT row_number() OVER (ORDER BY head) AS id, 'Http' AS transport, 'GET' AS method, concat('handler-', head) AS key, concat(head, '/:id') AS raw
FROM (SELECT DISTINCT split_part(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', ''), '/', 1) AS head FROM pages)
"""

VIEWS = {
    "g_nodes": NODES, "g_edges": EDGES, "k_nodes": CYCLE_NODES, "k_edges": CYCLE_EDGES, "g_commit_files": COMMIT_FILES, "g_changed": CHANGED,
    "t_nodes": TEXT_NODES, "t_edges": TEXT_EDGES, "r_consumers": ROUTE_CONSUMERS, "r_producers": ROUTE_PRODUCERS,
}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the driver's tables (a name of VIEWS, or a text); only tables that it names are read."""
    sql = VIEWS.get(sql, sql)
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """A DuckDB query with the views it names in front; a recursive one says so itself."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in sql]
    if not used:
        return sql
    head = sql.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + head[len("WITH RECURSIVE") :]
    if head.upper().startswith("WITH"):
        return "WITH " + ", ".join(used) + ", " + head[len("WITH") :]
    return "WITH " + ", ".join(used) + " " + head
