"""Other names of documents: names and headings from their own words, questions as test cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aliases as A
from tessera.operators import sections as S
from tessera.plans.section_queries import _WINDOWS
from tessera.sources.tables import table

#: Both engines read these expressions: a document's name, what a window is, and the name that the case of a number expects.
_NAME = "concat('붙임 1_', substr(text, 1, 26), '.md')"
_MADE = {
    "chunk_id": "window_index + 10", "title": "concat('ENC ', substr(content, 1, 26))", "section_title": "concat('2) ', substr(content, 30, 34))", "p2": "concat('- ', substr(content, 70, 20))",
    "text": "replace(content, '. ', concat('?', chr(10), 'Q: '))",
}
_EXPECTED = "CASE WHEN doc_id % 3 = 0 THEN concat('x', substr(text, 1, 26), 'y') ELSE substr(text, 3, 9) END"


def _candidates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").filter("length(text) > 0")
    files = docs.selectExpr("doc_id", f"{_NAME} AS name", "concat('/k/', doc_id) AS path")
    chunks = S.windows(docs).selectExpr("doc_id", *[f"{e} AS {n}" for n, e in _MADE.items()]).withColumn("section_path", F.array("title", "p2"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.substring("text", 1, 50).alias("question"))
    cases = docs.join(asked, "doc_id").selectExpr("doc_id AS case_id", f"{_EXPECTED} AS expected", "question")
    return A.candidates(files, chunks, cases)


def alias_candidates(spark, sf):
    return _candidates(spark, sf)


def alias_report(spark, sf):
    return A.report(_candidates(spark, sf))


def alias_sources(spark, sf):
    return A.source_counts(_candidates(spark, sf))


QUERIES = {f.__name__: f for f in (alias_candidates, alias_report, alias_sources)}


def _clean(text: str) -> str:
    for pattern, by in A.CLEANING:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), by)
    return f"trim({text})"


_DENSE = "lower(regexp_replace({0}, '" + A.COMPACT.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', '', 'g'))"
_KEY = r"lower(regexp_replace(regexp_replace(list_last(string_split(replace({0}, '\', '/'), '/')), '(?i)\.(md|txt)$', ''), '\s+', '', 'g'))"
_USEFUL = "length({1}) >= 3 AND NOT regexp_matches({1}, '^[0-9]+$') AND NOT regexp_matches({1}, '^20[0-9]{{2}}년?$') AND NOT regexp_matches({0}, '(?i)https?://') AND length({0}) <= 90 AND len(regexp_split_to_array({0}, '\\s+')) <= 12"
_FOUND = f"""{_WINDOWS},
docs AS (SELECT doc_id, text FROM documents WHERE length(text) > 0), files AS (SELECT doc_id, {_NAME} AS name, '/k/' || doc_id AS path FROM docs), own AS (SELECT *, {_clean("name")} AS canonical FROM files),
chunks AS (SELECT doc_id, {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM windows),
cases AS (SELECT doc_id AS case_id, {_EXPECTED} AS expected, question FROM docs JOIN (SELECT item_id, substr(text, 1, 50) AS question FROM benchmark) ON item_id = doc_id),
pairs AS (SELECT case_id, min(doc_id) AS doc_id FROM (SELECT case_id, expected, {_KEY.format("expected")} AS k FROM cases) JOIN (SELECT doc_id, {_KEY.format("name")} AS t FROM files) ON k <> '' AND t <> '' AND (contains(t, k) OR contains(k, t)) GROUP BY case_id),
fragments AS (SELECT doc_id, canonical, unnest(fs) AS f, generate_subscripts(fs, 1) AS k FROM (SELECT doc_id, canonical, list_filter(list_transform(regexp_split_to_array(canonical, '{A.FRAGMENT_CUT}'), lambda p: {_clean("p")}), lambda p: {_USEFUL.format("p", _DENSE.format("p"))} AND p NOT IN ({", ".join(repr(w) for w in A.TITLE_NOISE)}) AND (length(p) >= 4 OR regexp_matches(p, '[가-힣]{{2,}}'))) AS fs FROM own)),
lines AS (SELECT doc_id, chunk_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, chunk_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{A.QUESTION}')) AS ls FROM chunks)),
rows_ AS (SELECT doc_id, 0 AS part, '' AS o, 0 AS k, name AS alias, 'file-title' AS source, path AS evidence FROM files UNION ALL SELECT doc_id, 0, '', k, f, 'heading', 'title-fragment:' || canonical FROM fragments
  UNION ALL SELECT doc_id, 1, chunk_id::VARCHAR, 0, title, 'document-title', chunk_id::VARCHAR FROM chunks UNION ALL SELECT doc_id, 1, chunk_id::VARCHAR, 1, section_title, 'heading', chunk_id::VARCHAR FROM chunks UNION ALL SELECT doc_id, 1, chunk_id::VARCHAR, 2, p2, 'heading', chunk_id::VARCHAR FROM chunks
  UNION ALL SELECT doc_id, 1, chunk_id::VARCHAR, 2 + k, concat_ws(' ', nullif(regexp_extract(l, '{A.QUESTION}', 1), ''), nullif(regexp_extract(l, '{A.QUESTION}', 2), '')), 'qa-question', chunk_id::VARCHAR FROM lines
  UNION ALL SELECT doc_id, 2, case_id::VARCHAR, 0, expected, 'benchmark-expected-doc', case_id::VARCHAR FROM cases JOIN pairs USING (case_id) UNION ALL SELECT doc_id, 2, case_id::VARCHAR, 1, question, 'benchmark-question', case_id::VARCHAR FROM cases JOIN pairs USING (case_id)),
clean AS (SELECT * REPLACE ({_clean("alias")} AS alias), CASE source {" ".join(f"WHEN '{s}' THEN {v}" for s, v in A.SOURCE_SCORES.items())} END::DOUBLE AS score FROM rows_),
keyed AS (SELECT *, {_DENSE.format("alias")} AS key FROM clean),
found AS (SELECT doc_id, canonical, alias, key, source, score, evidence FROM (SELECT * FROM keyed WHERE {_USEFUL.format("alias", "key")} QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, part, o, k) = 1) JOIN own USING (doc_id))"""
SQL = {
    "alias_candidates": f"WITH {_FOUND} SELECT * FROM found",
    "alias_report": f"WITH {_FOUND}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, source, alias) AS place FROM found) SELECT doc_id, canonical, count(*) AS n, string_agg(alias, '|' ORDER BY place) FILTER (place <= 12) AS aliases FROM p GROUP BY ALL",
    "alias_sources": f"WITH {_FOUND} SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM found GROUP BY source",
}
