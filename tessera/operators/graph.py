"""An entity graph as tables: entities, aliases, edges; look-up and depth-bounded expansion of seed entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(entity_id, entity_type, label) of several tables: (table, type, id column, label column)."""
    out = None
    for df, kind, key, label in parts:
        one = df.select(F.concat_ws(":", F.lit(kind), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(*parts: tuple[DataFrame, str, str, str, str, str, float]) -> DataFrame:
    """(src, dst, relation, weight): (table, from type, from column, relation, to type, to column, weight)."""
    out = None
    for df, a, a_col, relation, b, b_col, weight in parts:
        one = df.select(
            F.concat_ws(":", F.lit(a), F.col(a_col).cast("string")).alias("src"), F.concat_ws(":", F.lit(b), F.col(b_col).cast("string")).alias("dst"),
            F.lit(relation).alias("relation"), F.lit(weight).alias("weight"),
        )
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def expand(seeds: DataFrame, links: DataFrame, depth: int = 2, base: float = 3.0, least: float = 2.0) -> DataFrame:
    """(seed, entity_id, hops, boost): what is reached from each seed, with max(least, weight * base) added for every edge walked.

    Edges are walked both ways, one join a hop; the paths of a hop are summed to one row for (seed, node) before the
    next, so their number stays at most seeds times nodes reached.
    """
    both = links.select("src", "dst", "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    frontier = seeds.select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node"))
    reached = frontier.select("seed", F.col("node").alias("entity_id"), F.lit(0).alias("hops"), F.lit(0.0).alias("boost"))
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("src")).groupBy("seed", "dst").agg(F.sum(F.greatest(F.lit(least), F.col("weight") * base)).alias("boost"))
        known = reached.select("seed", F.col("entity_id").alias("dst")).distinct()
        frontier = step.join(known, ["seed", "dst"], "left_anti").select("seed", F.col("dst").alias("node"))
        reached = reached.unionByName(step.select("seed", F.col("dst").alias("entity_id"), F.lit(hop).alias("hops"), "boost"))
    return reached.groupBy("seed", "entity_id").agg(F.min("hops").alias("hops"), F.sum("boost").alias("boost"))


def degrees(links: DataFrame) -> DataFrame:
    """(entity_id, n_out, n_in)."""
    out = links.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = links.groupBy(F.col("dst").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_in"))
    zero = F.lit(0).cast("long")
    return out.join(into, "entity_id", "full_outer").select("entity_id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))
