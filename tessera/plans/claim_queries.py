"""Claims over windows of documents: anchors of the benchmark's own words, plans of Korean questions, numbers of windows against their documents' neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import claims as C
from tessera.operators import questions as U
from tessera.operators import sections as S
from tessera.plans import question_queries as Q
from tessera.plans.section_queries import _WINDOWS
from tessera.sources.tables import spread, table

TYPES = ("cost", "workflow", "compliance", "document", "definition")
RULES = (
    ("cost-core-evidence", ("cost",), ("service_scope", "recipient_grade"), {"legal": 1}, ("has-cost",)), ("workflow-basis", ("workflow",), ("service_scope",), {"evaluation": 2, "practical": 1}, ("requires",)),
    ("compliance-basis", ("compliance", "eligibility"), ("service_scope", "institution_type"), {"legal": 2, "practical": 1}, ("exception-of",)),
)
#: Both engines read these expressions: what a window is.
_MADE = {
    "chunk_id": "doc_id * 100000 + window_index", "title": "substr(content, 1, 24)", "section_title": "substr(content, 30, 40)", "labels": "substr(content, 100, 30)", "search_text": "substr(content, 1, 600)", "text_preview": "substr(content, 1, 220)",
    "source_type": "CASE doc_id % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'manual' WHEN 2 THEN 'evaluation' ELSE 'notice' END", "mode": "CASE WHEN doc_id % 3 = 0 THEN 'evaluation' ELSE 'integrated' END",
    "source_role": "CASE doc_id % 5 WHEN 0 THEN 'primary_evaluation' ELSE 'general' END", "article_no": "CASE WHEN window_index % 2 = 0 THEN '제1조' END",
}


def _chunks(spark, sf):
    rows = S.windows(spread(table(spark, sf, "documents").select("doc_id", "text")))
    return rows.selectExpr("doc_id", "window_index", "content AS text", *[f"{e} AS {n}" for n, e in _MADE.items()])


def _claims(spark, sf):
    """A claim a benchmark text: anchors are parts of it, written with signs, and the two domain words of its kind."""
    t = "text"
    anchors = F.array(F.substring(t, 1, 7), F.concat(F.substring(t, 9, 8), F.lit("!")), F.substring(t, 20, 5), F.substring(t, 30, 12), F.concat(F.lit("("), F.substring(t, 3, 4)), F.lit("기준"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("item_id") % len(TYPES)).cast("int"))
    hints = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("legal"))).otherwise(F.array(F.lit("evaluation"), F.lit("practical")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("claim-main").alias("claim_id"), kind.alias("claim_type"), anchors.alias("anchors"), hints.alias("hints"), F.array().cast("array<string>").alias("scopes"))


def claim_support(spark, sf):
    """Claims against all windows."""
    return C.claim_support(_claims(spark, sf), _chunks(spark, sf))


def claim_coverage(spark, sf):
    claims = _claims(spark, sf)
    return C.claim_coverage(claims, C.claim_support(claims, _chunks(spark, sf)))


def claim_plans(spark, sf):
    own, hits, slots, frames = Q._frames(spark, sf)
    requests = U.relation_requests(frames)
    terms = U.variants(own, U.entities(own, hits, slots), slots, requests)
    plan = C.claim_plan(frames, slots, terms, requests)
    return plan.select("query_id", "claim_id", "claim_type", "subject", "predicate", "object", F.array_join("anchors", "|").alias("anchors"), F.array_join("hints", "|").alias("hints"))


def retrieval_issues(spark, sf):
    """Issues of each Korean question: its evidence are all windows of its number, whole ones, its claims those of its text."""
    own, hits, slots, frames = Q._frames(spark, sf)
    claims, chunks = _claims(spark, sf), _chunks(spark, sf).withColumn("search_text", F.col("text"))
    evidence = chunks.select((F.col("doc_id") % 50).alias("query_id"), "chunk_id").join(own.select("query_id"), "query_id", "left_semi")
    support = C.claim_support(claims, chunks, evidence)
    rules = spark.createDataFrame(RULES, "rule_id string, intents array<string>, slots array<string>, buckets map<string,int>, relations array<string>")
    return C.retrieval_issues(frames, claims, C.claim_coverage(claims, support), support, evidence, chunks, rules, U.relation_requests(frames))


def grounded_numbers(spark, sf):
    """Numbers of each document's first window against those of its other windows."""
    w = _chunks(spark, sf)
    return C.cited_numbers(w.filter("window_index = 0").selectExpr("doc_id AS answer_id", "text"), w.filter("window_index > 0").selectExpr("doc_id AS answer_id", "text"))


def loose_citations(spark, sf):
    """Turns as citations of their conversation: a turn cites the window of its number twice over, evidence are even windows."""
    cited = table(spark, sf, "conversations").selectExpr("conv_id AS answer_id", "CAST(floor(turn / 2) AS BIGINT) AS chunk_id", "turn AS place")
    return C.loose_citations(cited, cited.filter("chunk_id % 3 <> 1"))


QUERIES = {f.__name__: f for f in (claim_support, claim_coverage, claim_plans, retrieval_issues, grounded_numbers, loose_citations)}

_PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '" + C.SIGNS.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), '\\s+', ' ', 'g'))"
_FIELDS = " UNION ALL ".join(f"SELECT chunk_id, {w}::DOUBLE AS w, {_PLAIN.format(n)} AS plain FROM chunks" for n, w in C.FIELDS)
_LEGAL = ", ".join(f"'{x}'" for x in C.LEGAL)
_SUPPORT = f"""{_WINDOWS},
chunks AS (SELECT doc_id, window_index, content AS text, {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM windows),
claims AS (SELECT item_id AS query_id, {list(TYPES)!r}[item_id % {len(TYPES)} + 1] AS claim_type, CASE WHEN item_id % 2 = 0 THEN ['legal'] ELSE ['evaluation', 'practical'] END AS hints,
  [substr(text, 1, 7), substr(text, 9, 8) || '!', substr(text, 20, 5), substr(text, 30, 12), '(' || substr(text, 3, 4), '기준'] AS anchors FROM benchmark),
asked AS (SELECT DISTINCT query_id, unnest(anchors) AS anchor FROM claims),
forms AS (SELECT anchor, {_PLAIN.format("anchor")} AS plain, replace({_PLAIN.format("anchor")}, ' ', '') AS dense, regexp_replace({_PLAIN.format("anchor")}, '{C.ENDINGS}', '') AS key FROM (SELECT DISTINCT anchor FROM asked)),
fields AS ({_FIELDS}),
held AS (SELECT anchor, chunk_id, max(CASE WHEN contains(fields.plain, forms.plain) THEN w ELSE greatest(1, round(w - 0.4, 9)) END) AS w FROM fields JOIN forms ON forms.plain <> '' AND (contains(fields.plain, forms.plain) OR (length(dense) >= 2 AND contains(replace(fields.plain, ' ', ''), dense))) GROUP BY ALL),
pairs AS (SELECT query_id, chunk_id, sum(w) AS points, count(*) AS n_anchors, count(*) FILTER (key NOT IN ({", ".join(repr(a) for a in C.DOMAIN_ANCHORS)})) AS n_specific FROM asked JOIN held USING (anchor) JOIN forms USING (anchor) GROUP BY ALL),
told AS (SELECT *, CASE WHEN source_type IN ({_LEGAL}) THEN 'legal' WHEN mode = 'evaluation' OR source_role = 'primary_evaluation' THEN 'evaluation' ELSE 'practical' END AS bucket FROM chunks),
met AS (SELECT query_id, chunk_id, n_anchors, n_specific, round(points + CASE WHEN list_contains(hints, bucket) THEN 1.2 ELSE 0 END + CASE WHEN bucket = 'legal' AND claim_type = 'cost' THEN 1.8 ELSE 0 END + CASE WHEN claim_type = 'workflow' AND source_role = 'primary_evaluation' THEN 2.2 ELSE 0 END
  + CASE WHEN claim_type = 'workflow' AND bucket = 'evaluation' THEN 1.4 ELSE 0 END + CASE WHEN claim_type = 'compliance' AND bucket = 'legal' THEN 1.4 ELSE 0 END + CASE WHEN claim_type = 'document' AND article_no IS NOT NULL THEN 0.8 ELSE 0 END, 6) AS score
  FROM pairs JOIN told USING (chunk_id) JOIN claims USING (query_id) WHERE n_specific >= 1),
v AS (SELECT *, CASE WHEN score >= 5.2 AND n_anchors >= 2 THEN 'supported' WHEN score >= 3.2 THEN 'partial' END AS verdict FROM met),
kept AS (SELECT * FROM (SELECT *, max(verdict) OVER (PARTITION BY query_id) AS top FROM v WHERE verdict IS NOT NULL) WHERE verdict = top),
support AS (SELECT query_id, 'claim-main' AS claim_id, chunk_id, score, n_anchors, n_specific, false AS scope_matched, verdict, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM kept QUALIFY place <= CASE WHEN verdict = 'supported' THEN 4 ELSE 3 END)"""
_NUMBERS = "(SELECT DISTINCT doc_id AS answer_id, replace(unnest(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)?%?')), ',', '.') AS number FROM (SELECT doc_id, window_index, regexp_replace(regexp_replace(content, '([0-9]),([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9]),([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g') AS t FROM windows) WHERE {1})"
SQL = {
    "claim_support": f"WITH {_SUPPORT} SELECT * FROM support",
    "claim_coverage": f"WITH {_SUPPORT}, tally AS (SELECT query_id, max(verdict) AS verdict, count(*) AS met FROM support GROUP BY query_id) SELECT query_id, 'claim-main' AS claim_id, coalesce(verdict, 'unsupported') AS status, coalesce(met, 0) AS n_evidence FROM claims LEFT JOIN tally USING (query_id)",
    "grounded_numbers": f"WITH {_WINDOWS}, a AS {_NUMBERS.format('t', 'window_index = 0')}, c AS {_NUMBERS.format('t', 'window_index > 0')} SELECT answer_id, number, c.number IS NOT NULL AS grounded FROM a LEFT JOIN c USING (answer_id, number)",
    "loose_citations": """WITH c AS (SELECT conv_id AS answer_id, (turn // 2)::BIGINT AS chunk_id, turn AS place FROM conversations), m AS (SELECT *, row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY place) AS first FROM c)
SELECT answer_id, chunk_id, place, CASE WHEN chunk_id % 3 = 1 THEN 'not-in-evidence' ELSE 'repeated' END AS fault FROM m WHERE chunk_id % 3 = 1 OR first > 1""",
}
