"""Index reports over the windows of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import manifest as M
from tessera.operators import quality as Y
from tessera.operators import sections as S
from tessera.plans.section_queries import _SECTIONS, _WINDOWS
from tessera.sources.tables import table

LANGUAGES = ["en", "de", "fr", "es", "nl"]


def _chunks(spark, sf):
    """Windows with the labels that a chunk builder would give them."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = F.array_compact(F.array(
        F.lit("x"), F.when(F.col("window_index") % 4 < 3, F.concat(F.lit("chunk-policy:"), "lang")), F.concat(F.lit("chunk-boundary:"), "source"),
        F.when(F.col("content").contains("\n"), "chunk-protected:group"), F.when(F.col("content").contains("license"), "chunk-protected:checklist"),
    ))
    rows = S.windows(table(spark, sf, "documents")).join(docs, "doc_id")
    return rows.select("doc_id", "source", "window_index", F.col("content").alias("text"), labels.alias("labels"), F.lit(None).cast("string").alias("list_group"), F.lit(None).cast("boolean").alias("checklist"))


def _entries(spark, sf):
    """A row a document: windows, windows with a vector (all but each third of a document that has one), type and mode."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_type"), F.when(F.col("lang") == "de", "evaluation").otherwise("integrated").alias("mode"))
    by = _embedded(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("embedded").alias("n_embedded"))
    return docs.join(by, "doc_id", "left").na.fill(0, ["n_chunks", "n_embedded"])


def _embedded(spark, sf):
    held = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")).distinct()
    chunks = S.windows(table(spark, sf, "documents")).select("doc_id", "window_index").join(held, "doc_id", "left")
    reason = F.when(F.col("has").isNull(), "no-vector").when(F.col("window_index") % 3 == 2, "")
    return chunks.select("doc_id", "window_index", (F.col("has").isNotNull() & (F.col("window_index") % 3 != 2)).alias("embedded"), reason.alias("reason"))


def index_coverage(spark, sf):
    return Y.coverage(_entries(spark, sf))


def index_description(spark, sf):
    return Y.index_row(_entries(spark, sf))


def language_domain(spark, sf):
    return Y.domain_counts(table(spark, sf, "documents"), "lang", LANGUAGES)


def chunk_policies(spark, sf):
    return Y.policy_report(_chunks(spark, sf))


def _parents(spark, sf):
    return Y.parents(S.windows(table(spark, sf, "documents")).withColumn("section", F.floor(F.col("window_index") / 5)).filter("window_index % 7 <> 3"))


def section_parents(spark, sf):
    return _parents(spark, sf)


def section_parent_summary(spark, sf):
    return Y.parent_summary(_parents(spark, sf))


def largest_sections(spark, sf):
    return Y.largest_parents(_parents(spark, sf))


def _issues(spark, sf):
    docs = table(spark, sf, "documents")
    return M.issues(docs, S.sections(docs))


def issue_codes(spark, sf):
    return _issues(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def issues_by_document(spark, sf):
    return Y.counted(_issues(spark, sf), "doc_id", "code")


def source_type_report(spark, sf):
    return Y.type_report(_entries(spark, sf), _issues(spark, sf))


def embedding_verify(spark, sf):
    return Y.missing_vectors(_embedded(spark, sf))


def review_signal_counts(spark, sf):
    signals = F.array_compact(F.array(F.when(F.col("event_type") == "error", "fallback_used"), F.when(F.col("value") < 5, "low_confidence")))
    return Y.log_summary(table(spark, sf, "events").select(signals.alias("signals")))


QUERIES = {f.__name__: f for f in (
    index_coverage, index_description, language_domain, chunk_policies, section_parents, section_parent_summary, largest_sections, issue_codes, issues_by_document, source_type_report,
    embedding_verify, review_signal_counts,
)}

_EMBEDDED = f"""{_WINDOWS},
emb AS (SELECT w.doc_id, w.window_index, v.vec_id IS NOT NULL AS has, v.vec_id IS NOT NULL AND w.window_index % 3 <> 2 AS embedded FROM windows w LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = w.doc_id),
entries AS (SELECT d.doc_id, d.source AS source_type, CASE WHEN d.lang = 'de' THEN 'evaluation' ELSE 'integrated' END AS mode, count(emb.doc_id) AS n_chunks, count(*) FILTER (embedded) AS n_embedded
  FROM documents d LEFT JOIN emb USING (doc_id) GROUP BY ALL)"""
_PARENTS = f"""{_WINDOWS},
k AS (SELECT doc_id, window_index // 5 AS section, window_index FROM windows WHERE window_index % 7 <> 3),
a AS (SELECT *, exists(SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.section = k.section AND b.window_index = k.window_index - 1)::INT AS p,
  exists(SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.section = k.section AND b.window_index = k.window_index + 1)::INT AS x FROM k),
parents AS (SELECT doc_id, section, count(*) AS n, min(window_index) AS first, max(window_index) AS last, sum(greatest(p, x))::BIGINT AS n_expandable, sum(p + x)::BIGINT AS n_neighbours FROM a GROUP BY doc_id, section)"""
_ISSUES = f"""{_SECTIONS},
h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS flat FROM documents),
c AS (SELECT doc_id, flat, count(*) OVER (PARTITION BY h) AS n FROM h),
issues AS (SELECT 'duplicate-content' AS code, doc_id FROM c WHERE n > 1 UNION ALL SELECT 'empty-document', doc_id FROM c WHERE flat = ''
  UNION ALL SELECT DISTINCT 'oversized-section', doc_id FROM sections WHERE length(content) > 4800)"""
SQL = {
    "index_coverage": f"WITH {_EMBEDDED} SELECT sum(n_embedded)::BIGINT AS n_embedded, sum(n_chunks)::BIGINT AS n_chunks, round(sum(n_embedded)::DOUBLE / sum(n_chunks), 4) AS ratio FROM entries",
    "index_description": f"WITH {_EMBEDDED} SELECT count(*) AS n_files, count(*) FILTER (mode = 'integrated') AS n_integrated, count(*) FILTER (mode = 'evaluation') AS n_evaluation, sum(n_chunks)::BIGINT AS n_chunks, sum(n_embedded)::BIGINT AS n_embedded, 'parquet' AS storage FROM entries",
    "language_domain": "SELECT x.lang, x.place::INTEGER AS place, count(d.doc_id) AS n FROM (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3), ('nl', 4)) x(lang, place) LEFT JOIN documents d ON d.lang = x.lang GROUP BY ALL",
    "chunk_policies": f"""WITH {_WINDOWS},
g AS (SELECT CASE WHEN window_index % 4 < 3 THEN lang ELSE 'unclassified' END AS policy, source AS reason, content, contains(content, chr(10)) OR contains(content, 'license') AS safe FROM windows JOIN documents USING (doc_id)),
b AS (SELECT policy, reason, count(*) AS n, count(*) FILTER (safe) AS n_protected, count(*) FILTER (contains(content, 'license')) AS n_checklist, count(*) FILTER (length(content) > 2400) AS n_oversized,
  count(*) FILTER (NOT safe AND length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 31) AS n_short FROM g GROUP BY ALL)
SELECT policy, sum(n)::BIGINT AS n_chunks, sum(n_protected)::BIGINT AS n_protected, sum(n_checklist)::BIGINT AS n_checklist, sum(n_oversized)::BIGINT AS n_oversized, sum(n_short)::BIGINT AS n_short, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM b GROUP BY policy""",
    "section_parents": f"WITH {_PARENTS} SELECT * FROM parents",
    "section_parent_summary": f"WITH {_PARENTS} SELECT count(*) AS n_sections, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 1) AS n_isolated, round(sum(n)::DOUBLE / count(*), 1) AS mean_chunks, max(n) AS most_chunks, sum(n_expandable)::BIGINT AS n_expandable, sum(n_neighbours)::BIGINT AS n_neighbours FROM parents",
    "largest_sections": f"WITH {_PARENTS} SELECT doc_id, section, n, first, last FROM parents ORDER BY n DESC, doc_id, section LIMIT 10",
    "issue_codes": f"WITH {_ISSUES} SELECT code, count(*) AS n FROM issues GROUP BY code",
    "issues_by_document": f"WITH {_ISSUES}, b AS (SELECT doc_id, code, count(*) AS n FROM issues GROUP BY ALL) SELECT doc_id, string_agg(code || '=' || n, ',' ORDER BY code) AS by_code, sum(n)::BIGINT AS n FROM b GROUP BY doc_id",
    "source_type_report": f"""WITH {_EMBEDDED}, {_ISSUES},
b AS (SELECT source_type, code, count(*) AS n FROM issues JOIN entries USING (doc_id) GROUP BY ALL),
o AS (SELECT source_type, sum(n)::BIGINT AS n_issues, string_agg(code || '=' || n, ',' ORDER BY code) AS by_code FROM b GROUP BY source_type),
y AS (SELECT source_type, count(*) AS n_documents, sum(n_chunks)::BIGINT AS n_chunks, sum(n_embedded)::BIGINT AS n_embedded FROM entries GROUP BY source_type)
SELECT source_type, n_documents, n_chunks, n_embedded, CASE WHEN n_chunks > 0 THEN round(n_embedded::DOUBLE / n_chunks, 4) ELSE 0 END AS coverage, round(n_chunks::DOUBLE / n_documents, 4) AS mean_chunks, coalesce(n_issues, 0) AS n_issues, coalesce(by_code, '') AS by_code
FROM y LEFT JOIN o USING (source_type)""",
    "embedding_verify": f"""WITH {_EMBEDDED},
r AS (SELECT doc_id, CASE WHEN has THEN 'unknown' ELSE 'no-vector' END AS reason, count(*) AS n FROM emb WHERE NOT embedded GROUP BY ALL),
t AS (SELECT doc_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM r GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (embedded) AS n_embedded FROM emb GROUP BY doc_id)
SELECT doc_id, n_chunks, n_embedded, n_chunks - n_embedded AS n_missing, coalesce(reasons, '') AS reasons, n_chunks > n_embedded AS retry FROM y LEFT JOIN t USING (doc_id)""",
    "review_signal_counts": "WITH s AS (SELECT event_type = 'error' AS a, coalesce(value < 5, FALSE) AS b FROM events), u AS (SELECT 'total' AS signal FROM s UNION ALL SELECT 'review' FROM s WHERE a OR b UNION ALL SELECT 'fallback_used' FROM s WHERE a UNION ALL SELECT 'low_confidence' FROM s WHERE b) SELECT signal, count(*) AS n FROM u GROUP BY signal",
}
