"""Registry of the retrieval queries: name, DataFrame builder, DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import alias_queries, chunk_queries, claim_queries, context_queries, graph_queries, grounding_queries, ontology_queries, overlay_queries, quality_queries, question_queries, report_queries, retrieval_queries, rule_queries, scoring_queries, section_queries, text_queries, trace_queries

MODULES = (text_queries, chunk_queries, context_queries, ontology_queries, question_queries, claim_queries, alias_queries, grounding_queries, overlay_queries, retrieval_queries, section_queries, report_queries, graph_queries, rule_queries, trace_queries, quality_queries, scoring_queries)

def queries() -> dict:
    """All registered builders by name."""
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out

def oracle_sql() -> dict:
    """All registered SQL texts by name."""
    out: dict = {}
    for module in MODULES:
        out |= module.SQL
    return out

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.hybrid_fused(spark, sf_dir)
