"""Sections, chunks and manifests of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import manifest as M
from tessera.operators import sections as S
from tessera.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def document_sections(spark, sf):
    return S.sections(_docs(spark, sf)).select("doc_id", "section_no", "start_line", "n_lines", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


def sliding_windows(spark, sf):
    w = S.neighbours(S.windows(_docs(spark, sf)).withColumn("content", F.md5("content")))
    return w.withColumnRenamed("content", "content_md5")


def packed_chunks(spark, sf):
    return S.packed(_docs(spark, sf)).select("doc_id", "chunk_index", "n_blocks", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def document_cards(spark, sf):
    return S.cards(S.sections(_docs(spark, sf)))


def _manifest(spark, sf):
    docs = _docs(spark, sf)
    return M.manifest(docs, S.windows(docs).select("doc_id"))


def file_manifest(spark, sf):
    return _manifest(spark, sf)


def manifest_fingerprints(spark, sf):
    return M.fingerprint(_manifest(spark, sf))


def manifest_diff(spark, sf):
    """The manifest against an index that lacks one language, has lost the changes to another and keeps a source too many."""
    disk = _manifest(spark, sf).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    index = disk.filter("lang <> 'de'").withColumn("size", F.when(F.col("lang") == "fr", F.col("size") + 1).otherwise(F.col("size")))
    return M.diff(disk.filter("source <> 'src3'"), index)


def data_issues(spark, sf):
    docs = _docs(spark, sf)
    return M.issues(docs, S.sections(docs))


def incremental_upsert(spark, sf):
    """Documents of one language replaced: their hash becomes the word changed."""
    docs = _docs(spark, sf).select("doc_id", "lang", F.md5("text").alias("h"))
    return M.upserted(docs, docs.filter("lang = 'es'").withColumn("h", F.lit("changed")), "doc_id")


QUERIES = {f.__name__: f for f in (document_sections, sliding_windows, packed_chunks, document_cards, file_manifest, manifest_fingerprints, manifest_diff, data_issues, incremental_upsert)}

_HEAD = r"^(#{1,6}\s+\S|제\s*[0-9]+\s*조|(부칙|별표)|[QA][0-9]*[.:]\s|[0-9]+(\.[0-9]+)*[.)]\s+\S)"
_SECTIONS = rf"""
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
m AS (SELECT *, sum(CASE WHEN line_no = 0 OR regexp_matches(line, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS section_no FROM e),
s AS (SELECT doc_id, section_no::INTEGER AS section_no, min(line_no)::INTEGER AS start_line, count(*)::INTEGER AS n_lines,
  trim(regexp_replace(arg_min(line, line_no), '^#{{1,6}}\s+', '')) AS title, string_agg(line, chr(10) ORDER BY line_no) AS content FROM m GROUP BY doc_id, section_no),
sections AS (SELECT * FROM s WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> '')"""
_WINDOWS = """
n AS (SELECT doc_id, coalesce(text, '') AS t, greatest(1, ceil((length(coalesce(text, '')) - 120) / 1080.0))::INTEGER AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, t, unnest(range(0, n))::INTEGER AS window_index FROM n),
windows AS (SELECT doc_id, window_index, window_index * 1080 AS span_start, least(window_index * 1080 + 1200, length(t))::INTEGER AS span_end, substr(t, window_index * 1080 + 1, 1200) AS content FROM w)"""
_MANIFEST = f"""{_WINDOWS},
manifest AS (SELECT source || '/' || doc_id AS path, doc_id, source, lang, sha256(coalesce(text, '')) AS content_hash, strlen(coalesce(text, '')) AS size,
  coalesce((SELECT count(*) FROM windows WHERE windows.doc_id = documents.doc_id), 0) AS chunk_count FROM documents)"""
SQL = {
    "document_sections": f"WITH {_SECTIONS} SELECT doc_id, section_no, start_line, n_lines, md5(title) AS title_md5, md5(content) AS content_md5 FROM sections",
    "sliding_windows": f"WITH {_WINDOWS} SELECT doc_id, window_index, span_start, span_end, md5(content) AS content_md5, lag(window_index) OVER o AS previous, lead(window_index) OVER o AS next FROM windows WINDOW o AS (PARTITION BY doc_id ORDER BY window_index)",
    "packed_chunks": """WITH RECURSIVE
lines AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> '') AS ls FROM documents),
sizes AS (SELECT doc_id, ls, list_transform(ls, lambda b: length(b)) AS ns FROM lines WHERE len(ls) > 0),
fold AS (SELECT doc_id, ls, ns, 1 AS i, 1 AS lo, 0 AS number, ns[1] AS size, 0 AS was FROM sizes
  UNION ALL SELECT doc_id, ls, ns, i + 1, CASE WHEN size + 1 + ns[i + 1] > 1200 THEN i + 1 ELSE lo END, CASE WHEN size + 1 + ns[i + 1] > 1200 THEN number + 1 ELSE number END, CASE WHEN size + 1 + ns[i + 1] > 1200 THEN ns[i + 1] ELSE size + 1 + ns[i + 1] END, lo FROM fold WHERE i < len(ns)),
cuts AS (SELECT doc_id, number AS chunk_index, min(i) AS a, max(i) AS b FROM fold GROUP BY ALL)
SELECT doc_id, chunk_index, (b - a + 1)::INTEGER AS n_blocks, length(array_to_string(ls[a:b], chr(10))) AS n_chars, md5(array_to_string(ls[a:b], chr(10))) AS content_md5 FROM cuts JOIN sizes USING (doc_id)""",
    "document_cards": f"""WITH {_SECTIONS},
firsts AS (SELECT doc_id, title, min(section_no) AS pos FROM sections GROUP BY ALL),
eight AS (SELECT doc_id, string_agg(title, ' | ' ORDER BY pos) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM firsts) WHERE r <= 8 GROUP BY doc_id)
SELECT doc_id, count(*) AS n_sections, sum(length(content))::BIGINT AS n_chars, any_value(titles) AS titles, substr(arg_min(content, section_no), 1, 220) AS summary FROM sections JOIN eight USING (doc_id) GROUP BY doc_id""",
    "file_manifest": f"WITH {_MANIFEST} SELECT path, doc_id, source, content_hash, size, chunk_count FROM manifest",
    "manifest_fingerprints": f"WITH {_MANIFEST} SELECT source, count(*) AS n, bit_xor(('0x' || substr(sha256(path || ':' || content_hash || ':' || size || ':' || chunk_count), 1, 15))::BIGINT) AS hash FROM manifest GROUP BY source",
    "manifest_diff": f"""WITH {_MANIFEST},
disk AS (SELECT * FROM manifest WHERE source <> 'src3'),
idx AS (SELECT path, content_hash, CASE WHEN lang = 'fr' THEN size + 1 ELSE size END AS size, chunk_count FROM manifest WHERE lang <> 'de')
SELECT coalesce(d.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'orphaned' ELSE 'stale' END AS status
FROM disk d FULL JOIN idx i ON d.path = i.path
WHERE i.path IS NULL OR d.path IS NULL OR (d.content_hash, d.size, d.chunk_count) <> (i.content_hash, i.size, i.chunk_count)""",
    "data_issues": f"""WITH {_SECTIONS},
h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS flat FROM documents),
c AS (SELECT doc_id, flat, count(*) OVER (PARTITION BY h) AS n FROM h)
SELECT 'duplicate-content' AS code, doc_id, n AS detail FROM c WHERE n > 1
UNION ALL SELECT 'empty-document', doc_id, 0 FROM c WHERE flat = ''
UNION ALL SELECT 'oversized-section', doc_id, count(*) FROM sections WHERE length(content) > 4800 GROUP BY doc_id""",
    "incremental_upsert": "SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'changed' ELSE md5(text) END AS h FROM documents",
}
