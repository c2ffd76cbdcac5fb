"""Gates and diagnostics over the lists of windows of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import grounding as G
from tessera.plans import context_queries as X
from tessera.plans import question_queries as U
from tessera.plans import retrieval_queries as Q

GENERIC = ("he t", "in t")
#: Both engines read these expressions: a question, what it is about, and what its list can be trusted with.
_ASKED = {
    "article_asked": "CASE WHEN query_id % 4 = 0 THEN concat('제', query_id % 9 + 1, '조') END", "focus": "array(substr(text, 3, 7), substr(text, 21, 5), substr(text, 40, 4))",
    "confidence": "CASE query_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END", "question": "CASE WHEN query_id % 2 = 0 THEN concat('절차 ', text) ELSE text END",
}
#: What a window's search text is, and the scores of a candidate.
_SEARCH, _EXACT, _LEXICAL, _VECTOR = "concat(substr(text, 1, 500), CASE WHEN doc_id % 3 = 0 THEN ' 초기 상담 계획' ELSE '' END)", "CASE WHEN chunk_id % 11 = 0 THEN 30.0 ELSE 0.0 END", "CASE WHEN chunk_id % 5 = 0 THEN 1.0 ELSE 0.0 END", "CASE WHEN chunk_id % 2 = 0 THEN 0.5 ELSE 0.0 END"


def _parts(spark, sf):
    chunks, candidates, evidence = X._lists(spark, sf)
    chunks = chunks.withColumn("search_text", F.expr(_SEARCH))
    asked = Q._questions(spark, sf).withColumnRenamed("question", "text")
    asked = asked.selectExpr("query_id", *[f"{e} AS {n}" for n, e in _ASKED.items()])
    scored = lambda df: df.selectExpr("*", f"CAST({_EXACT} AS DOUBLE) AS exact_score", f"CAST({_LEXICAL} AS DOUBLE) AS lexical_score", f"CAST({_VECTOR} AS DOUBLE) AS vector_score")
    return chunks, scored(candidates), scored(evidence.filter("rank <= 5")), asked


def grounding_gates(spark, sf):
    chunks, _, evidence, asked = _parts(spark, sf)
    return G.grounding(evidence, chunks, asked)


def focus_gates(spark, sf):
    chunks, candidates, _, asked = _parts(spark, sf)
    return G.focus_gate(candidates, chunks, asked)


def candidate_diagnostics(spark, sf):
    chunks, candidates, evidence, asked = _parts(spark, sf)
    out = G.candidate_diagnostics(candidates, evidence, chunks, asked, GENERIC)
    return out.withColumn("reasons", F.array_join("reasons", "|"))


def expansion_profiles(spark, sf):
    """Korean questions and how far their lists reach."""
    return U.asked(spark, sf).select("query_id", G.expansion_profile(F.col("normal")).alias("p")).select("query_id", "p.*")


QUERIES = {f.__name__: f for f in (grounding_gates, focus_gates, candidate_diagnostics, expansion_profiles)}

_DUCK = {n: e.replace("array(", "list_value(") for n, e in _ASKED.items()}
_GATES = f"""{X._LISTS},
told AS (SELECT *, {_SEARCH} AS search_text FROM chunks), weighed AS (SELECT *, {_EXACT} AS exact_score, {_LEXICAL} AS lexical_score, {_VECTOR} AS vector_score FROM candidates),
asked AS (SELECT query_id, {", ".join(f"{e} AS {n}" for n, e in _DUCK.items())} FROM (SELECT item_id AS query_id, text FROM benchmark)),
focused AS (SELECT s.*, doc_id, section_id, window_index, article_no, article_asked, search_text, text, question, list_filter(focus, lambda t: t <> '' AND contains(lower(search_text), lower(t))) AS m FROM weighed s JOIN told USING (chunk_id) JOIN asked USING (query_id))"""
_EVIDENCE_TERMS = "list_filter([{}], lambda t: contains(lower(regexp_replace(search_text || ' ' || text, '\\s+', '', 'g')), t))".format(", ".join(f"'{''.join(t.split())}'" for t in R.PROCEDURE_EVIDENCE))
SQL = {
    "grounding_gates": f"""WITH {_GATES},
e AS (SELECT *, {_EVIDENCE_TERMS} AS terms FROM focused WHERE rank <= 5),
s AS (SELECT query_id, bool_or(exact_score >= 40 OR coalesce(article_no = article_asked, false)) AS exact, count(DISTINCT doc_id) FILTER (len(m) > 0 OR exact_score >= 25 OR lexical_score > 0) >= 2 AS cross_document,
  any_value(starts_with(question, '절차')) AND count(*) FILTER (len(terms) >= 2 OR len(m) > 0 OR lexical_score > 0 OR exact_score >= 10) >= 2 AND len(list_distinct(flatten(list(terms)))) >= 3 AS procedure FROM e GROUP BY query_id),
r AS (SELECT DISTINCT a.query_id FROM e a JOIN e b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.section_id = b.section_id AND b.window_index = a.window_index + 1),
g AS (SELECT asked.query_id, coalesce(exact, false) AS exact, r.query_id IS NOT NULL AS sequential, coalesce(cross_document, false) AS cross_document, coalesce(procedure, false) AS procedure FROM asked LEFT JOIN s USING (query_id) LEFT JOIN r USING (query_id))
SELECT *, exact OR sequential OR cross_document OR procedure AS passed FROM g""",
    "focus_gates": f"""WITH {_GATES},
h AS (SELECT query_id, len(list_distinct(flatten(list(m)))) AS n_matched FROM focused WHERE rank <= 10 GROUP BY query_id),
g AS (SELECT query_id, len(focus) AS n_focus, h.n_matched AS held, coalesce(h.n_matched, 0) AS n_matched, starts_with(question, '절차') AS relaxed, CASE WHEN starts_with(question, '절차') THEN 1 ELSE least(CASE WHEN len(focus) >= 3 THEN 2 ELSE 1 END, len(focus)) END AS needed, confidence AS c FROM asked LEFT JOIN h USING (query_id)),
gated AS (SELECT *, n_focus = 0 OR held IS NULL OR n_matched >= needed AS passed FROM g)
SELECT query_id, n_focus, n_matched, needed, passed, CASE WHEN passed OR (relaxed AND c = 'medium') THEN c WHEN c = 'high' THEN 'medium' WHEN c = 'medium' THEN 'low' ELSE c END AS confidence FROM gated""",
    "candidate_diagnostics": f"""WITH {_GATES},
own AS (SELECT f.query_id, chunk_id, doc_id, section_id, window_index, score FROM focused f WHERE rank <= 5),
d AS (SELECT f.query_id, f.chunk_id, f.rank, f.rank <= 5 AS selected, len(list_filter(m, lambda t: t NOT IN ({", ".join(repr(g) for g in GENERIC)}))) AS n_focus, vector_score, score,
  EXISTS (SELECT 1 FROM own o WHERE o.query_id = f.query_id AND o.doc_id = f.doc_id) AS doc_in, EXISTS (SELECT 1 FROM own o WHERE o.query_id = f.query_id AND o.doc_id = f.doc_id AND o.section_id = f.section_id) AS sec_in,
  EXISTS (SELECT 1 FROM own o WHERE o.query_id = f.query_id AND o.doc_id = f.doc_id AND o.section_id = f.section_id AND abs(o.window_index - f.window_index) <= 1) AS near_in, (SELECT min(score) FROM own o WHERE o.query_id = f.query_id) AS least FROM focused f)
SELECT query_id, chunk_id, rank, selected, n_focus, CASE WHEN selected THEN '' ELSE array_to_string(list_filter([CASE WHEN n_focus = 0 THEN 'generic-only-match' END, CASE WHEN doc_in AND NOT sec_in THEN 'document-cluster-limit' END, CASE WHEN sec_in AND NOT near_in THEN 'non-adjacent-window-in-selected-cluster' END,
  CASE WHEN score < least THEN 'lower-rerank-score-than-selected-evidence' END, CASE WHEN vector_score <= 0 THEN 'no-vector-signal' END], lambda x: x IS NOT NULL), '|') END AS reasons FROM d""",
    "expansion_profiles": f"""WITH {U._UNDERSTOOD},
k AS (SELECT query_id, lower(regexp_replace(normal, '\\s+', '', 'g')) AS t FROM asked),
c AS (SELECT query_id, CASE WHEN {{0}} AND {{1}} AND {{2}} THEN 'enumeration' WHEN {{3}} AND {{4}} THEN 'checklist' ELSE 'plain' END AS kind FROM k)
SELECT query_id, kind, CASE kind WHEN 'enumeration' THEN 48 ELSE 24 END AS fused_top_k, CASE kind WHEN 'enumeration' THEN 28 WHEN 'checklist' THEN 22 ELSE 18 END AS evidence_top_k, CASE kind WHEN 'enumeration' THEN 5 WHEN 'checklist' THEN 4 ELSE 2 END AS per_document,
  CASE kind WHEN 'enumeration' THEN 5 WHEN 'checklist' THEN 3 ELSE 2 END AS per_cluster, CASE kind WHEN 'enumeration' THEN 4 ELSE 0 END AS forced FROM c""",
}
for _k, _words in enumerate(([s for names in G.ENTITY_ANCHORS.values() for s in names], G.EVENT_CUES, G.TASK_CUES, G.CHECKLIST_CUES, G.OPERATIONAL_CUES)):
    SQL["expansion_profiles"] = SQL["expansion_profiles"].replace(f"{{{_k}}}", "(" + " OR ".join(f"contains(t, '{''.join(w.split()).lower()}')" for w in _words) + ")")
