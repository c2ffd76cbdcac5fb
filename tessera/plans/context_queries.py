"""Lists of windows of documents for all questions, and what they gain from sections, neighbours, lists and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rules import QUALIFIERS
from tessera.operators import context as C
from tessera.operators import retrieval as R
from tessera.operators import sections as S
from tessera.plans import retrieval_queries as Q
from tessera.plans.section_queries import _WINDOWS
from tessera.sources.tables import table

EVIDENCE = 12
ROLE_CHARS = {"routing_summary": 3000, "support_reference": 2700}
#: Entities of the tables' own words; the second shares a synonym with the first.
ANCHORS = {"tion": ("ontion", "tion of"), "the": ("in the", "tion of", "the er"), "ment": ("aument", "iment"), "ado": ("ado de", "mente el"), "ung": ("ung der", "keit und")}
#: Both engines read these expressions: what a window is, from its numbers and text.
_MADE = {
    "chunk_id": "doc_id * 100000 + window_index", "section_id": "doc_id * 1000 + CAST(floor(window_index / 3) AS BIGINT)", "heading": "substr(content, 1, 40)", "section_title": "substr(content, 1, 9)",
    "list_group_id": "CASE WHEN doc_id % 4 = 1 THEN concat('list', doc_id % 40) END", "contains_checklist": "window_index % 5 = 0", "article_no": "CASE WHEN doc_id % 6 = 0 THEN concat('제', window_index + 1, '조') END",
    "source_role": "CASE doc_id % 4 WHEN 0 THEN 'primary_evaluation' WHEN 1 THEN 'support_reference' WHEN 2 THEN 'routing_summary' ELSE 'general' END",
    "label": "CASE doc_id % 5 WHEN 0 THEN 'chunk-policy:evaluation' WHEN 1 THEN 'chunk-policy:law' WHEN 2 THEN 'chunk-protected:checklist' WHEN 3 THEN 'chunk-policy:manual' ELSE 'x' END",
    "title": "concat(CASE WHEN doc_id % 9 = 0 THEN '01-02-' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN 'qa' ELSE 'd' END, doc_id % 50)",
}


def _chunks(spark, sf):
    rows = S.windows(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.selectExpr("doc_id", "window_index", "content AS text", *[f"{e} AS {n}" for n, e in _MADE.items()]).withColumn("matched_labels", F.array("label")).drop("label")


def _lists(spark, sf):
    """(chunks, candidates, evidence): 24 windows a question by lexical score, the first of them its evidence."""
    chunks = _chunks(spark, sf)
    found = R.lexical(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), Q._questions(spark, sf))
    candidates = found.select("query_id", F.col("doc_id").alias("chunk_id"), "rank", F.round(F.col("score") * 15, 9).alias("score"))
    return chunks, candidates, candidates.filter(F.col("rank") <= EVIDENCE)


def _focus(spark, sf):
    return Q._questions(spark, sf).select("query_id", F.array(F.substring("question", 3, 6), F.substring("question", 21, 4)).alias("focus"))


def section_routes(spark, sf):
    chunks, candidates, _ = _lists(spark, sf)
    return C.section_routes(candidates, chunks)


def routed_lists(spark, sf):
    chunks, candidates, _ = _lists(spark, sf)
    return C.routed(candidates, chunks, _focus(spark, sf))


def small_to_big(spark, sf):
    chunks, _, evidence = _lists(spark, sf)
    return C.small_to_big(evidence, chunks, role_chars=ROLE_CHARS)


def small_to_big_summary(spark, sf):
    chunks, _, evidence = _lists(spark, sf)
    return C.small_to_big_summary(C.small_to_big(evidence, chunks, role_chars=ROLE_CHARS))


def sequential_grounding(spark, sf):
    chunks, candidates, _ = _lists(spark, sf)
    return C.in_sequence(candidates, chunks)


def list_groups(spark, sf):
    chunks, candidates, evidence = _lists(spark, sf)
    return C.with_list_groups(evidence, candidates, chunks, EVIDENCE + 4)


def entity_coverage(spark, sf):
    chunks, candidates, evidence = _lists(spark, sf)
    return C.with_entities(evidence, candidates, chunks, Q._questions(spark, sf), C.anchor_table(spark, ANCHORS))


def entity_candidates(spark, sf):
    chunks, candidates, _ = _lists(spark, sf)
    return C.anchored_candidates(chunks, Q._questions(spark, sf), C.anchor_table(spark, ANCHORS), candidates)


QUERIES = {f.__name__: f for f in (section_routes, routed_lists, small_to_big, small_to_big_summary, sequential_grounding, list_groups, entity_coverage, entity_candidates)}

_LISTS = f"""{_WINDOWS},
chunks AS (SELECT doc_id, window_index, content AS text, {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM windows),
corpus AS (SELECT chunk_id AS doc_id, text FROM chunks), {Q._LEX.replace("documents", "corpus")},
candidates AS (SELECT query_id, doc_id AS chunk_id, rank, round(score * 15, 9) AS score FROM lex), evidence AS (SELECT * FROM candidates WHERE rank <= {EVIDENCE})"""
_SIBLINGS = """
siblings AS (SELECT chunk_id, lag(chunk_id) OVER o AS before, lead(chunk_id) OVER o AS after FROM chunks WINDOW o AS (PARTITION BY doc_id, section_id ORDER BY window_index)),
near AS (SELECT chunk_id, 0 AS relation, before AS neighbour FROM siblings WHERE before IS NOT NULL UNION ALL SELECT chunk_id, 1, after FROM siblings WHERE after IS NOT NULL),
role_points AS (SELECT chunk_id, doc_id, source_role, label, text, CASE source_role WHEN 'primary_evaluation' THEN 40 WHEN 'support_reference' THEN 20 WHEN 'routing_summary' THEN 15 ELSE 10 END AS rp,
  CASE label WHEN 'chunk-policy:evaluation' THEN 12 WHEN 'chunk-policy:law' THEN 10 WHEN 'chunk-protected:checklist' THEN 8 WHEN 'chunk-policy:manual' THEN 4 ELSE 0 END AS lp FROM chunks)"""
_CONTEXT = f"""{_LISTS}, {_SIBLINGS},
met AS (SELECT e.query_id, n.neighbour, e.rank, n.relation, e.score, a.rp AS anchor FROM evidence e JOIN near n USING (chunk_id) JOIN role_points a USING (chunk_id)
  WHERE NOT EXISTS (SELECT 1 FROM evidence x WHERE x.query_id = e.query_id AND x.chunk_id = n.neighbour) QUALIFY row_number() OVER (PARTITION BY e.query_id, n.neighbour ORDER BY e.rank, n.relation) = 1),
ranked AS (SELECT query_id, neighbour AS chunk_id, rank, relation, round(rp + anchor + lp + score / 10, 9) AS priority, length(text) AS n_chars,
  CASE WHEN length(text) <= 700 THEN length(text) ELSE length(regexp_replace(substr(text, 1, 700), '\\s+$', '')) + 3 END AS n_used FROM met JOIN role_points r ON r.chunk_id = neighbour),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, rank, relation) AS place FROM ranked),
budgets AS (SELECT query_id, max(CASE source_role WHEN 'routing_summary' THEN 3000 WHEN 'support_reference' THEN 2700 ELSE 2400 END) AS budget FROM evidence JOIN chunks USING (chunk_id) GROUP BY query_id),
fold AS (
  SELECT query_id, 0::BIGINT AS place, 0 AS n, 0::BIGINT AS used, '' AS verdict FROM budgets
  UNION ALL
  SELECT query_id, place, n + (verdict = 'included')::INTEGER, used + CASE WHEN verdict = 'included' THEN n_used ELSE 0 END, verdict
  FROM (SELECT f.query_id, p.place, f.n, f.used, p.n_used, CASE WHEN f.n >= 6 THEN 'skipped-chunks' WHEN f.used + p.n_used > b.budget THEN 'skipped-chars' ELSE 'included' END AS verdict
    FROM fold f JOIN budgets b USING (query_id) JOIN placed p ON p.query_id = f.query_id AND p.place = f.place + 1)),
context AS (SELECT p.query_id, p.place, chunk_id, n_chars, n_used, priority, verdict FROM placed p JOIN fold f ON f.query_id = p.query_id AND f.place = p.place)"""
_QUALIFIER = "|".join(f"(?:{p})" for patterns in QUALIFIERS.values() for p in patterns)
_NEEDLES = ", ".join(f"('{name}', {k}, ['{"', '".join("".join(s.split()).lower() for s in synonyms)}'])" for k, (name, synonyms) in enumerate(ANCHORS.items()))
_HELD = """(SELECT {key}, anchor_id, place, list_sum(list_transform(list_filter(needles, lambda n: contains(dense, n)), lambda n: length(n))) AS points
  FROM (SELECT {key}, lower(regexp_replace({text}, '\\s+', '', 'g')) AS dense FROM {rows}) JOIN anchors ON len(list_filter(needles, lambda n: contains(dense, n))) > 0)"""
_ENTITIES = f"""{_LISTS},
anchors AS (SELECT * FROM (VALUES {_NEEDLES}) t(anchor_id, place, needles)),
wanted AS {_HELD.format(key="item_id", text="text", rows="benchmark")}, held AS {_HELD.format(key="chunk_id", text="text", rows="chunks")},
named AS (SELECT *, title || '::' || coalesce(article_no, section_title) AS indicator FROM chunks)"""
SQL = {
    "section_routes": f"""WITH {_LISTS}, tally AS (SELECT query_id, section_id, count(*) AS n, min(rank) AS first, min(doc_id) AS doc_id FROM candidates JOIN chunks USING (chunk_id) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, section_id)::INTEGER AS place, section_id, doc_id, n FROM tally QUALIFY place <= 3""",
    "routed_lists": f"""WITH {_LISTS},
m AS (SELECT c.*, section_id, lower(heading) AS h, lower(substr(b.text, 3, 6)) AS f1, lower(substr(b.text, 21, 4)) AS f2 FROM candidates c JOIN chunks USING (chunk_id) JOIN benchmark b ON item_id = query_id),
s AS (SELECT *, score + CASE WHEN EXISTS (SELECT 1 FROM m x WHERE x.query_id = m.query_id AND x.section_id = m.section_id AND x.rank <= 6) THEN 6 + CASE WHEN contains(h, f1) OR contains(h, f2) THEN 3 ELSE 0 END ELSE 0 END AS routed_score FROM m)
SELECT query_id, chunk_id, section_id, rank AS was, score, routed_score, row_number() OVER (PARTITION BY query_id ORDER BY routed_score DESC, rank) AS rank FROM s""",
    "small_to_big": f"WITH RECURSIVE {_CONTEXT} SELECT * FROM context",
    "small_to_big_summary": f"""WITH RECURSIVE {_CONTEXT} SELECT query_id, count(*) AS n_candidates, count(*) FILTER (verdict = 'included') AS n_included, count(*) FILTER (verdict = 'skipped-chunks') AS n_skipped_chunks,
  count(*) FILTER (verdict = 'skipped-chars') AS n_skipped_chars, coalesce(sum(n_used) FILTER (verdict = 'included'), 0)::BIGINT AS chars FROM context GROUP BY query_id""",
    "sequential_grounding": f"""WITH {_LISTS}, m AS (SELECT query_id, doc_id, section_id, window_index FROM candidates JOIN chunks USING (chunk_id)),
runs AS (SELECT a.query_id, count(b.window_index) AS n_runs FROM m a LEFT JOIN m b ON b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.section_id = a.section_id AND b.window_index = a.window_index + 1 GROUP BY a.query_id)
SELECT query_id, n_runs, n_runs > 0 AS sequential FROM runs""",
    "list_groups": f"""WITH {_LISTS},
m AS (SELECT c.*, list_group_id FROM candidates c JOIN chunks USING (chunk_id) WHERE list_group_id IS NOT NULL),
room AS (SELECT query_id, {EVIDENCE + 4} - count(*) AS room FROM evidence GROUP BY query_id),
more AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS turn FROM m JOIN room USING (query_id) WHERE rank > {EVIDENCE} AND EXISTS (SELECT 1 FROM m x WHERE x.query_id = m.query_id AND x.list_group_id = m.list_group_id AND x.rank <= 30) QUALIFY turn <= room),
rows_ AS (SELECT query_id, chunk_id, score, false AS expanded, rank AS o FROM evidence UNION ALL SELECT query_id, chunk_id, score + 4, true, 1000 + rank FROM more)
SELECT query_id, chunk_id, score, expanded, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM rows_ QUALIFY rank <= {EVIDENCE + 4}""",
    "entity_coverage": f"""WITH RECURSIVE {_ENTITIES},
marks AS (SELECT e.query_id, e.chunk_id, arg_min(h.anchor_id, h.place) AS anchor_id FROM evidence e JOIN held h USING (chunk_id) JOIN wanted w ON w.item_id = e.query_id AND w.anchor_id = h.anchor_id GROUP BY ALL),
open_ AS (SELECT c.query_id, c.chunk_id, c.score, c.rank, indicator, h.anchor_id, h.place, h.points FROM candidates c JOIN named USING (chunk_id) JOIN held h USING (chunk_id) JOIN wanted w ON w.item_id = c.query_id AND w.anchor_id = h.anchor_id
  WHERE c.rank > {EVIDENCE} AND NOT EXISTS (SELECT 1 FROM evidence e JOIN named n USING (chunk_id) WHERE e.query_id = c.query_id AND n.indicator = named.indicator)),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, points DESC, score DESC, rank) AS turn FROM open_),
fold AS (
  SELECT DISTINCT query_id, 0::BIGINT AS turn, CAST([] AS VARCHAR[]) AS inds, CAST([] AS BIGINT[]) AS ids, false AS took FROM turns
  UNION ALL
  SELECT query_id, turn, CASE WHEN ok THEN list_append(inds, indicator) ELSE inds END, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END, ok
  FROM (SELECT f.query_id, t.turn, f.inds, f.ids, t.indicator, t.chunk_id, len(f.ids) < 4 AND NOT list_contains(f.inds, t.indicator) AND NOT list_contains(f.ids, t.chunk_id) AS ok FROM fold f JOIN turns t ON t.query_id = f.query_id AND t.turn = f.turn + 1))
SELECT e.query_id, e.chunk_id, e.score, e.rank, m.anchor_id, false AS forced, m.anchor_id IS NOT NULL AS by_entity FROM evidence e LEFT JOIN marks m ON m.query_id = e.query_id AND m.chunk_id = e.chunk_id
UNION ALL SELECT t.query_id, t.chunk_id, t.score, t.rank, t.anchor_id, true, true FROM turns t JOIN fold f ON f.query_id = t.query_id AND f.turn = t.turn WHERE f.took""",
    "entity_candidates": f"""WITH {_ENTITIES},
strong AS (SELECT w.item_id AS query_id, h.chunk_id, h.anchor_id, h.points FROM wanted w JOIN held h USING (anchor_id) QUALIFY row_number() OVER (PARTITION BY w.item_id, h.chunk_id ORDER BY h.points DESC, h.place) = 1),
s AS (SELECT s.query_id, s.chunk_id, s.anchor_id, s.points, indicator, coalesce(c.score, 0) + 24 + s.points + CASE WHEN contains_checklist THEN 18 ELSE 0 END + CASE WHEN regexp_matches(text, '{_QUALIFIER}') THEN 8 ELSE 0 END
  + CASE WHEN source_role = 'primary_evaluation' THEN 40 ELSE 0 END + CASE WHEN regexp_matches(title, '{C.NUMBERED_TITLE}') THEN 80 ELSE 0 END + CASE WHEN regexp_matches(title || ' ' || section_title, '{C.WORKFLOW_TITLE}') THEN 30 ELSE 0 END
  + CASE WHEN regexp_matches(text, '{C.QUALIFIER_TERMS}') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(title || ' ' || section_title, '{C.QA_TITLE}') THEN 28 ELSE 0 END
  + CASE WHEN len(list_filter(a.needles, lambda n: contains(lower(regexp_replace(section_title, '\\s+', '', 'g')), n))) > 0 THEN 12 ELSE 0 END AS score
  FROM strong s JOIN named n USING (chunk_id) JOIN anchors a USING (anchor_id) LEFT JOIN candidates c ON c.query_id = s.query_id AND c.chunk_id = s.chunk_id),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, indicator ORDER BY score DESC, chunk_id) = 1)
SELECT query_id, chunk_id, anchor_id, points::INTEGER AS points, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 12""",
}
