"""The entity graph of the star schema: regions, nations, customers, suppliers, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import graph as G
from tessera.plans.text_queries import TOKENS_SQL
from tessera.sources.tables import table


def _entities(spark, sf):
    t = lambda n: table(spark, sf, n)
    return G.entities(
        (t("region"), "region", "r_regionkey", "r_name"), (t("nation"), "nation", "n_nationkey", "n_name"),
        (t("customer"), "customer", "c_custkey", "c_name"), (t("supplier"), "supplier", "s_suppkey", "s_name"), (t("part"), "part", "p_partkey", "p_name"),
    )


def _edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    return G.edges(
        (t("nation"), "nation", "n_nationkey", "in-region", "region", "n_regionkey", 1.0),
        (t("supplier"), "supplier", "s_suppkey", "in-nation", "nation", "s_nationkey", 0.8),
        (t("customer"), "customer", "c_custkey", "in-nation", "nation", "c_nationkey", 0.8),
        (t("orders"), "customer", "o_custkey", "placed", "order", "o_orderkey", 0.5),
        (t("lineitem"), "supplier", "l_suppkey", "supplies", "part", "l_partkey", 0.6),
    )


def graph_entities(spark, sf):
    return _entities(spark, sf)


def graph_degrees(spark, sf):
    return G.degrees(_edges(spark, sf))


def graph_expansion(spark, sf):
    """What the regions reach within two hops."""
    return G.expand(_entities(spark, sf).filter("entity_type = 'region'"), _edges(spark, sf), 2)


def alias_tokens(spark, sf):
    """Tokens of entity labels with the number of entities of each type that bear them."""
    named = _entities(spark, sf).select("entity_type", F.explode(tokens(F.col("label"))).alias("token"))
    return named.groupBy("entity_type", "token").agg(F.count(F.lit(1)).alias("n"))


def dangling_edges(spark, sf):
    """Edge ends, orders aside, that are no entity: what a manifest check would refuse."""
    ends = _edges(spark, sf).filter("relation <> 'placed'").select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return ends.join(_entities(spark, sf), "entity_id", "left_anti")


QUERIES = {f.__name__: f for f in (graph_entities, graph_degrees, graph_expansion, alias_tokens, dangling_edges)}

_ENT = """
ent AS (SELECT 'region:' || r_regionkey AS entity_id, 'region' AS entity_type, r_name AS label FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part)"""
_EDG = """
edg AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in-region' AS relation, 1.0::DOUBLE AS weight FROM nation
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in-nation', 0.8 FROM supplier UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in-nation', 0.8 FROM customer
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed', 0.5 FROM orders UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 0.6 FROM lineitem)"""
SQL = {
    "graph_entities": f"WITH {_ENT} SELECT * FROM ent",
    "graph_degrees": f"""WITH {_EDG}, o AS (SELECT src AS entity_id, count(*) AS n FROM edg GROUP BY 1), i AS (SELECT dst AS entity_id, count(*) AS n FROM edg GROUP BY 1)
SELECT coalesce(o.entity_id, i.entity_id) AS entity_id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM o FULL JOIN i ON o.entity_id = i.entity_id""",
    "graph_expansion": f"""WITH {_ENT}, {_EDG},
both_ways AS (SELECT src, dst, weight FROM edg UNION ALL SELECT dst, src, weight FROM edg),
h0 AS (SELECT entity_id AS seed, entity_id AS node FROM ent WHERE entity_type = 'region'),
h1 AS (SELECT seed, dst, sum(greatest(2.0, weight * 3)) AS boost FROM h0 JOIN both_ways ON node = src GROUP BY ALL),
f1 AS (SELECT seed, dst AS node FROM h1 WHERE (seed, dst) NOT IN (SELECT (seed, node) FROM h0)),
h2 AS (SELECT seed, dst, sum(greatest(2.0, weight * 3)) AS boost FROM f1 JOIN both_ways ON node = src GROUP BY ALL),
r AS (SELECT seed, node AS entity_id, 0 AS hops, 0.0::DOUBLE AS boost FROM h0 UNION ALL SELECT seed, dst, 1, boost FROM h1 UNION ALL SELECT seed, dst, 2, boost FROM h2)
SELECT seed, entity_id, min(hops)::INTEGER AS hops, sum(boost) AS boost FROM r GROUP BY ALL""",
    "alias_tokens": rf"""WITH {_ENT}, t AS (SELECT entity_type, unnest({TOKENS_SQL.format("label")}) AS token FROM ent)
SELECT entity_type, token, count(*) AS n FROM t GROUP BY ALL""",
    "dangling_edges": f"WITH {_ENT}, {_EDG}, e AS (SELECT src AS entity_id FROM edg WHERE relation <> 'placed' UNION SELECT dst FROM edg WHERE relation <> 'placed') SELECT entity_id FROM e WHERE entity_id NOT IN (SELECT entity_id FROM ent)",
}
