"""Reranked lists of all questions: fused candidates meet the names, kinds and roles of their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import scoring as C
from tessera.plans import retrieval_queries as Q
from tessera.plans.text_queries import CUT_SQL
from tessera.sources.tables import table

KINDS = ("law", "manual", "qa", "comparison", "evaluation", "guide")
#: Both engines read these expressions: a document's kind, role, mode and date, and a question's intent, mode and class.
_DOC = {
    "source_type": "element_at(array('law', 'manual', 'qa', 'comparison', 'evaluation', 'guide'), CAST(doc_id % 6 AS INT) + 1)",
    "source_role": "element_at(array('primary_evaluation', 'support_reference', 'routing_summary', 'general'), CAST(doc_id % 4 AS INT) + 1)",
    "doc_mode": "IF(doc_id % 3 = 0, 'evaluation', 'integrated')", "effective_date": "IF(doc_id % 5 = 0, '2023-04-01', NULL)", "path": "IF(doc_id % 8 = 0, '/knowledge/evaluation/x.md', '/knowledge/x.md')",
}
_ASKED = {
    "intent": "element_at(array('legal-exact', 'manual-qna', 'synthesis', 'other'), CAST(query_id % 4 AS INT) + 1)", "mode": "IF(query_id % 2 = 0, 'evaluation', 'integrated')", "linked": "query_id % 3 = 0",
    "priority": "element_at(array('legal_judgment', 'evaluation_readiness', 'operational_workflow', 'document_lookup', 'comparison_definition'), CAST(query_id % 5 AS INT) + 1)",
    "aliases": "array(substr(question, 1, 12), 'x')", "laws": "CAST(NULL AS ARRAY<STRUCT<name: STRING, article: STRING, clause: STRING, item: STRING>>)",
}


def _asked(spark, sf):
    return C.question_context(Q._questions(spark, sf)).selectExpr("*", *[f"{e} AS {n}" for n, e in _ASKED.items()])


def _chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = docs.withColumns({"title": F.split("text", "\n", -1)[0], "name": F.substring("text", 1, 30), "section": F.substring("text", 40, 200), "search_text": F.col("text"), "article_no": F.lit(None).cast("string"), "has_list": F.lit(False)})
    return C.chunk_context(named.selectExpr("*", *[f"{e} AS {n}" for n, e in _DOC.items()]))


def _reranked(spark, sf):
    found = Q.hybrid_fused(spark, sf).select("query_id", "doc_id", "fused", "lexical_score", F.lit(None).cast("double").alias("vector_score"))
    return C.reranked(found.join(_chunks(spark, sf), "doc_id").join(_asked(spark, sf), "query_id"))


def reranked_lists(spark, sf):
    return _reranked(spark, sf)


def guarded_lists(spark, sf):
    return C.drift_guarded(_reranked(spark, sf))


QUERIES = {f.__name__: f for f in (reranked_lists, guarded_lists)}

_SUM = lambda *pairs: " + ".join(f"CASE WHEN {test} THEN {n}::DOUBLE ELSE 0 END" for test, n in pairs)
_LEGAL, _FIRST, _SUPPORT = "(kind = 'law')", "(role = 'primary_evaluation')", "(role = 'support_reference' AND own = 'evaluation')"
_PRIORITY = f"""CASE priority
  WHEN 'legal_judgment' THEN {_SUM((_LEGAL, 24), (f"NOT {_LEGAL} AND {_FIRST}", -6), ("kind = 'manual'", -2), (_SUPPORT, -1.5), ("kind = 'qa'", -7), ("kind = 'guide'", -6))}
  WHEN 'evaluation_readiness' THEN {_SUM((_FIRST, 22), (_SUPPORT, 14), ("kind = 'manual'", 4.5), (_LEGAL, 2.1))}
  WHEN 'operational_workflow' THEN {_SUM(("kind = 'manual'", 16), ("kind = 'guide'", 10), ("kind = 'qa'", 6.4), (f"{_FIRST} AND linked", 6.5), (f"{_FIRST} AND NOT linked", 8), (f"{_SUPPORT} AND linked", 6))}
  WHEN 'document_lookup' THEN {_SUM(("exact_score >= 18", 18), (_FIRST, 2.8), ("kind = 'manual'", 3.2), (_LEGAL, 3.2))}
  ELSE {_SUM(("kind = 'comparison'", 16), ("kind = 'manual'", 10.2), ("kind = 'qa'", 3.3), (_LEGAL, 3.15))} END"""
_C = Q._COMPACT
_RERANKED = rf"""WITH {Q._FUSED},
asked AS (SELECT item_id AS query_id, coalesce(text, '') AS question, {_C.format("text")} AS wanted, list_filter(cut, lambda t, i: list_position(cut, t) = i) AS tokens, {_C.format("substr(text, 1, 12)")} AS alias,
  ['legal-exact', 'manual-qna', 'synthesis', 'other'][(item_id % 4)::INT + 1] AS intent, CASE WHEN item_id % 2 = 0 THEN 'evaluation' ELSE 'integrated' END AS mode, item_id % 3 = 0 AS linked,
  ['legal_judgment', 'evaluation_readiness', 'operational_workflow', 'document_lookup', 'comparison_definition'][(item_id % 5)::INT + 1] AS priority FROM (SELECT *, {CUT_SQL.format("text")} AS cut FROM benchmark)),
chunk AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10))[1] AS title, substr(coalesce(text, ''), 1, 30) AS name, substr(coalesce(text, ''), 40, 200) AS section,
  ['law', 'manual', 'qa', 'comparison', 'evaluation', 'guide'][(doc_id % 6)::INT + 1] AS kind, ['primary_evaluation', 'support_reference', 'routing_summary', 'general'][(doc_id % 4)::INT + 1] AS role,
  CASE WHEN doc_id % 3 = 0 THEN 'evaluation' ELSE 'integrated' END AS own, CASE WHEN doc_id % 5 = 0 THEN '2023-04-01' END AS effective_date, doc_id % 8 = 0 AS in_wiki FROM documents),
c0 AS (SELECT * EXCLUDE (exact_score), {_C.format("title")} AS tc, {_C.format("name")} AS nc, {_C.format("section")} AS sc FROM fused_list JOIN chunk USING (doc_id) JOIN asked USING (query_id)),
c1 AS (SELECT *, {_SUM(("length(wanted) >= 4 AND contains(tc, wanted)", 28), ("length(wanted) >= 4 AND (contains(tc, wanted) OR (length(tc) >= 4 AND contains(wanted, tc)) OR contains(nc, wanted) OR (length(nc) >= 4 AND contains(wanted, nc)))", 34), ("mode = 'evaluation' AND own = 'evaluation'", 6))}
  + coalesce(list_sum(list_transform(tokens, lambda t: CASE WHEN contains(tc, t) THEN 6 ELSE 0 END + CASE WHEN contains(sc, t) THEN 4 ELSE 0 END)), 0)
  + CASE WHEN length(alias) < 2 THEN 0 WHEN contains(tc, alias) THEN 30 WHEN contains(sc, alias) THEN 18 ELSE 0 END
  + {_SUM(("intent = 'legal-exact' AND kind = 'law'", 8), ("intent = 'manual-qna' AND kind IN ('manual', 'qa', 'guide')", 8), ("intent = 'synthesis' AND kind IN ('comparison', 'qa', 'manual')", 4))} AS exact_score,
  CASE WHEN len(tokens) > 0 THEN least(48, coalesce(list_sum(list_transform(tokens[1:12], lambda t: CASE WHEN contains(lower(concat_ws(' ', title, section)), t) THEN 8 WHEN contains(lower(text), t) THEN 2 ELSE 0 END)), 0))::DOUBLE ELSE 0 END AS h,
  {_SUM((_FIRST, 28), ("role = 'support_reference'", 8), ("role = 'routing_summary'", -32), (f"{_FIRST} AND in_wiki", -72), ("regexp_matches(lower(concat_ws(' ', title, name, section)), 'q&a|qa')", -10),
    (r"regexp_extract(concat_ws(' ', title, name, effective_date), '\b(20[0-9]{2})\b', 1) <> ''", r"greatest(-10, 8 - 2 * greatest(0, 2025 - try_cast(regexp_extract(concat_ws(' ', title, name, effective_date), '\b(20[0-9]{2})\b', 1) AS INT)))"))} AS authority FROM c0),
c2 AS (SELECT *, CASE WHEN priority = 'legal_judgment' THEN least(h, 8) ELSE h END AS heading_score FROM c1),
c3 AS (SELECT query_id, doc_id, exact_score::DOUBLE AS exact_score, heading_score::DOUBLE AS heading_score, round(100 * fused + 1.8::DOUBLE * exact_score + 15 * coalesce(lexical_score, 0) + heading_score
  + CASE priority WHEN 'legal_judgment' THEN least(authority, 8) WHEN 'evaluation_readiness' THEN authority ELSE least(authority, 24) END
  + {_SUM(("intent = 'legal-exact' AND kind = 'law'", 8), ("intent = 'manual-qna' AND kind = 'qa'", 8), ("intent = 'manual-qna' AND kind IN ('manual', 'guide')", 5), ("intent = 'synthesis' AND kind = 'comparison'", 6),
    ("mode = 'evaluation' AND own = 'evaluation'", 6), (r"kind = 'evaluation' AND role = 'primary_evaluation' AND length(regexp_replace(text, '[\s#*_`>|:.\-()\[\]{}]', '', 'g')) < 24", -96),
    ("mode = 'integrated' AND intent = 'legal-exact' AND own = 'integrated'", 12), ("mode = 'integrated' AND intent = 'legal-exact' AND own = 'evaluation'", -8))}
  + {_PRIORITY}, 6) AS rerank_score FROM c2),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM c3)"""
SQL = {
    "reranked_lists": f"{_RERANKED} SELECT * FROM reranked",
    "guarded_lists": f"""{_RERANKED},
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact_score DESC, doc_id) = 1 AND exact_score > 0 AND rank > 1 AS guarded, max(rerank_score) OVER (PARTITION BY query_id) - rerank_score + 1 AS gap FROM reranked),
l AS (SELECT query_id, doc_id, exact_score, heading_score, guarded, round(rerank_score + CASE WHEN guarded THEN least(96, greatest(18, gap)) ELSE 0 END, 6) AS rerank_score FROM b)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM l""",
}
