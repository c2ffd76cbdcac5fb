"""The ontology of documents: their windows as chunks, sentences as list lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ontology as O
from tessera.operators import sections as S
from tessera.plans import retrieval_queries as Q
from tessera.plans.section_queries import _WINDOWS
from tessera.plans.text_queries import TOKENS_SQL
from tessera.sources.tables import spread, stored, table

SUFFIXES, LETTERS = ("tion", "u ng", "ment", "idad", "TH"), "[a-z]"
RULES = (
    ("tion", (), "same-as", "Ontion", "condition", 0.9), ("u", ("ung der", "de la"), "applies-to", "Gerung de", "institution", 1.05), ("th", (), "applies-to", "Gerung de", "place", 0.5), ("ment|ung", (), "uses-document", None, "document", 0.95),
)
#: Both engines read these expressions: what a window is.
_MADE = {
    "title": "concat('제 3 조 ', substr(t, 1, 22), '.md')", "name": "concat('2.1) **', substr(t, 1, 30), '**,')", "section_title": "concat('## ', substr(content, 1, 28))", "text": "replace(replace(content, '. ', concat('.', chr(10), '- ')), ', ', concat(chr(10), '* '))",
    "source_type": "CASE WHEN doc_id % 4 = 0 THEN 'law' ELSE 'guide' END",
}


def _chunks(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = S.windows(docs).join(docs.select("doc_id", F.substring("text", 1, 30).alias("t")), "doc_id")  # titles and names read no more of it
    return rows.selectExpr("doc_id", "window_index AS chunk_index", *[f"{e} AS {n}" for n, e in _MADE.items()])


def _parts(spark, sf):
    """Candidates as a table in the shared folder: concepts, relations and the graph read them several times."""
    chunks = _chunks(spark, sf)
    candidates = stored(O.concept_candidates(chunks, SUFFIXES, LETTERS), "ontology-candidates")
    known = candidates.filter("doc_id % 10 = 0 AND place <= 2").selectExpr(
        "label", "element_at(array('promoted', 'validated', 'rejected', 'candidate'), CAST(floor(doc_id / 10) % 4 AS INT) + 1) AS status", "0.9D AS confidence", "CASE WHEN doc_id % 20 = 0 THEN 'actor' END AS entity_type",
        "'curated' AS source", "CAST(NULL AS STRING) AS status_reason",
    )
    concepts = O.manifest(candidates, known, cleaned=True)
    relations = O.concept_relations(candidates, O.document_words(chunks), RULES)
    return chunks.filter("chunk_index = 0"), candidates, concepts, relations


def _graph(spark, sf):
    """What the graph's tables read several times is made once, in the shared folder."""
    files, candidates, concepts, relations = _parts(spark, sf)
    files = stored(files.select("doc_id", "title", "name", "source_type"), "ontology-files")
    return O.graph(files, candidates, stored(concepts, "ontology-concepts"), stored(relations, "ontology-relations"))


def _stored_graph(spark, sf):
    """The graph as tables in the shared folder: a walk reads them at every hop."""
    tables = _graph(spark, sf)
    return {name: stored(df, f"ontology-{name}") for name, df in tables.items()}


def ontology_candidates(spark, sf):
    return O.concept_candidates(_chunks(spark, sf), SUFFIXES, LETTERS)


def ontology_relations(spark, sf):
    chunks = _chunks(spark, sf)
    return O.concept_relations(O.concept_candidates(chunks, SUFFIXES, LETTERS), O.document_words(chunks), RULES)


def ontology_concepts(spark, sf):
    return _parts(spark, sf)[2]


def ontology_entities(spark, sf):
    return _graph(spark, sf)["entities"]


def ontology_aliases(spark, sf):
    return _graph(spark, sf)["aliases"]


def ontology_edges(spark, sf):
    return _graph(spark, sf)["edges"]


def _variants(spark, sf):
    return Q._questions(spark, sf).select("query_id", F.explode(F.array("question", F.substring("question", 1, 24))).alias("text"))


def ontology_hits(spark, sf):
    return O.lookup(_variants(spark, sf), _graph(spark, sf)["aliases"])


def ontology_expansion(spark, sf):
    """Documents near each question's hits and near the document that has its number, two edges far; hubs are dealt over several keys."""
    tables, asked = _stored_graph(spark, sf), Q._questions(spark, sf)
    weights = asked.filter("query_id % 2 = 0").select("query_id", F.lit("mentions-concept").alias("relation"), F.lit(1.5).alias("factor"))
    hits = stored(O.lookup(_variants(spark, sf), tables["aliases"]), "ontology-hits")
    return O.expand(hits, asked.select("query_id", F.col("query_id").alias("doc_id")), tables, 2, weights, hub_edges=50)


QUERIES = {f.__name__: f for f in (ontology_candidates, ontology_relations, ontology_concepts, ontology_entities, ontology_aliases, ontology_edges, ontology_hits, ontology_expansion)}

_DENSE = r"regexp_replace(lower({0}), '[^\x{{ac00}}-\x{{d7a3}}\x{{1100}}-\x{{11ff}}\x{{3130}}-\x{{318f}}0-9a-z]+', '', 'g')"


def _clean(text: str) -> str:
    for pattern, by in O.CLEANING:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({text})"


_WORDS = "[" + ", ".join(f"'{''.join(s.split()).lower()}'" for s in SUFFIXES) + "]"
_PARTS = f"""{_WINDOWS},
chunks AS (SELECT doc_id, window_index AS chunk_index, {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM windows JOIN (SELECT doc_id, text AS t FROM documents) USING (doc_id)),
files AS (SELECT * FROM chunks WHERE chunk_index = 0),
lines AS (SELECT doc_id, chunk_index, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM chunks WHERE chunk_index < 12),
raws AS (SELECT doc_id, chunk_index, raw, pos, 'document-text' AS source, 0.74::DOUBLE AS confidence FROM lines WHERE regexp_matches(raw, '^\\s*[-*+]\\s+') UNION ALL SELECT doc_id, chunk_index, section_title, 0, 'section-title', 0.72 FROM chunks WHERE chunk_index < 12
  UNION ALL SELECT doc_id, 0, title, -2, 'document-title', 0.82 FROM files UNION ALL SELECT doc_id, 0, name, -1, 'document-title', 0.78 FROM files),
labels AS (SELECT *, {_DENSE.format("label")} AS key FROM (SELECT *, {_clean("raw")} AS label FROM raws)),
shaped AS (SELECT * FROM labels WHERE length(label) BETWEEN 2 AND 42 AND regexp_matches(label, '{LETTERS}') AND len(list_filter({_WORDS}, lambda w: contains(key, w))) > 0),
best AS (SELECT *, first_value(chunk_index * 100000 + pos) OVER (PARTITION BY doc_id, key ORDER BY chunk_index, pos) AS first FROM shaped QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY confidence DESC, chunk_index, pos) = 1),
firsts AS (SELECT doc_id, key, min(chunk_index * 100000 + pos) AS first FROM shaped GROUP BY ALL),
candidates AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f.first, key)::INTEGER AS place, key, label, source, confidence FROM best JOIN firsts f USING (doc_id, key) QUALIFY place <= 24),
dense AS (SELECT doc_id, {_DENSE.format("string_agg(title || ' ' || section_title || ' ' || text, ' ' ORDER BY chunk_index)")} AS dense FROM chunks WHERE chunk_index < 6 GROUP BY doc_id),
said AS ({" UNION ALL ".join(
    f"SELECT doc_id, key, '{relation}' AS relation, {repr(target) if target else 'label'} AS target, '{kind}' AS target_type, {weight}::DOUBLE AS weight, {k} AS k FROM candidates JOIN dense USING (doc_id) WHERE regexp_matches(label, '{pattern}')"
    + (f" AND ({' OR '.join(f'contains(dense, {repr(w.replace(' ', ''))})' for w in needed)})" if needed else "") for k, (pattern, needed, relation, target, kind, weight) in enumerate(RULES))}),
relations AS (SELECT * EXCLUDE (k) FROM said QUALIFY row_number() OVER (PARTITION BY doc_id, key, relation, target ORDER BY k) = 1),
known AS (SELECT label, {_DENSE.format("label")} AS key, ['promoted', 'validated', 'rejected', 'candidate'][(doc_id // 10) % 4 + 1] AS status, 0.9::DOUBLE AS confidence, CASE WHEN doc_id % 20 = 0 THEN 'actor' END AS entity_type, 'curated' AS source FROM candidates WHERE doc_id % 10 = 0 AND place <= 2),
turns AS (SELECT 0 AS part, label AS doc, 0 AS place, * FROM known UNION ALL SELECT 1, doc_id::VARCHAR, place, label, key, 'candidate', confidence, NULL, source FROM candidates),
concepts AS (SELECT key, arg_min(label, (part, doc, place, label)) AS label, coalesce(arg_min(status, (part, doc, place, status)) FILTER (status <> 'candidate'), 'candidate') AS status, round(max(confidence), 3) AS confidence,
  arg_min(entity_type, (part, doc, place, entity_type)) FILTER (entity_type IS NOT NULL) AS entity_type, arg_min(source, (part, doc, place, source)) AS source, NULL::VARCHAR AS status_reason, count(*) AS n FROM turns GROUP BY key)"""
_GRAPH = f"""{_PARTS},
docs AS (SELECT doc_id, title, name, source_type, 'document:' || {_DENSE.format("title")} AS document, 'law:' || {_DENSE.format("title")} AS law FROM files),
met AS (SELECT c.*, document, 'concept:' || key AS concept FROM candidates c JOIN docs USING (doc_id)),
kept AS (SELECT key, label, status, confidence, CASE status WHEN 'promoted' THEN 1.35 WHEN 'validated' THEN 1.15 ELSE 0.78 END::DOUBLE AS weight, coalesce(entity_type, 'concept') AS kind, coalesce(entity_type, 'concept') || ':' || key AS concept FROM concepts WHERE status <> 'rejected'),
goals AS (SELECT r.*, kept.* EXCLUDE (key, weight), kept.weight AS own, target_type || ':' || {_DENSE.format("target")} AS goal FROM (SELECT DISTINCT key, relation, target, target_type, weight AS w FROM relations) r JOIN kept USING (key)),
e0 AS (SELECT 0 AS turn, document AS entity_id, 'document' AS entity_type, title AS label, NULL AS status, NULL::DOUBLE AS confidence FROM docs UNION ALL SELECT 2, law, 'law', title, NULL, NULL FROM docs WHERE source_type = 'law'
  UNION ALL SELECT 1, concept, 'concept', label, 'candidate', confidence FROM met UNION ALL SELECT 3, concept, kind, label, status, confidence FROM kept UNION ALL SELECT 4, goal, target_type, target, status, w FROM goals),
entities AS (SELECT entity_id, entity_type, arg_min(label, (turn, label)) AS label, arg_max(status, (turn, status, confidence)) FILTER (status IS NOT NULL) AS status, round(arg_max(confidence, (turn, status, confidence)) FILTER (status IS NOT NULL), 3) AS confidence FROM e0 GROUP BY ALL),
a0 AS (SELECT 0 AS turn, document AS entity_id, title AS alias, 'title' AS alias_type, 1.4::DOUBLE AS weight FROM docs UNION ALL SELECT 0, document, name, 'file-name', 1.2 FROM docs UNION ALL SELECT 1, concept, label, 'generated-concept', confidence FROM met
  UNION ALL SELECT 2, law, title, 'canonical-law', 1.6 FROM docs WHERE source_type = 'law' UNION ALL SELECT 2, law, name, 'canonical-law-file', 1.2 FROM docs WHERE source_type = 'law'
  UNION ALL SELECT 3, concept, label, 'generated-' || status || '-label', weight FROM kept UNION ALL SELECT 4, goal, target, 'generated-' || status || '-relation-target', round(greatest(0.65, own - 0.1), 9) FROM goals),
aliases AS (SELECT entity_id, key, alias, alias_type, weight FROM (SELECT *, {_DENSE.format("alias")} AS key FROM a0) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY entity_id, alias_type, key ORDER BY turn, alias, weight) = 1),
g0 AS (SELECT 1 AS turn, document AS src, concept AS dst, 'mentions-concept' AS relation, confidence AS weight, 'candidate' AS status FROM met UNION ALL SELECT 2, document, law, 'documents-law', 1.3, NULL FROM docs WHERE source_type = 'law'
  UNION ALL SELECT 3, concept, goal, relation, w, status FROM goals UNION ALL SELECT 4, document, k.concept, 'evidenced-by', weight, status FROM (SELECT DISTINCT key, document FROM met) JOIN kept k USING (key)),
edges AS (SELECT src, dst, relation, weight, status FROM g0 QUALIFY row_number() OVER (PARTITION BY src, relation, dst ORDER BY turn, weight, status) = 1),
bindings AS (SELECT document AS entity_id, doc_id FROM docs UNION SELECT concept, doc_id FROM met UNION SELECT law, doc_id FROM docs WHERE source_type = 'law' UNION SELECT k.concept, doc_id FROM candidates JOIN kept k USING (key))"""
_SIGNIFICANT = "list_filter({0}, lambda t: NOT regexp_matches(t, '^[0-9]+$'))"
_HITS = f"""{_GRAPH},
asked AS (SELECT DISTINCT item_id AS query_id, {_DENSE.format("t")} AS dense, {_SIGNIFICANT.format(TOKENS_SQL.format("t"))} AS toks FROM (SELECT item_id, text AS t FROM benchmark UNION ALL SELECT item_id, substr(text, 1, 24) FROM benchmark) WHERE dense <> ''),
own AS (SELECT *, {_SIGNIFICANT.format(TOKENS_SQL.format("alias"))} AS own FROM aliases),
points AS (SELECT query_id, entity_id, alias, 12 * weight AS score FROM asked JOIN aliases ON key = dense UNION ALL SELECT query_id, entity_id, alias, 6 * weight FROM asked JOIN aliases ON length(key) >= 3 AND contains(dense, key)
  UNION ALL SELECT query_id, entity_id, alias, (4 + n * 2 + n / least(len(toks), len(own))::DOUBLE * 4) * weight FROM (SELECT *, len(list_intersect(toks, own)) AS n FROM asked JOIN own ON list_has_any(toks, own)) WHERE n >= 2 AND n / least(len(toks), len(own))::DOUBLE >= 0.45),
scored AS (SELECT query_id, entity_id, round(score, 9) AS score, alias FROM points QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY round(score, 9) DESC, alias) = 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM scored QUALIFY rank <= 12)"""
_STEP = """SELECT query_id, other AS entity_id, sum(greatest(2, weight * CASE WHEN relation = 'mentions-concept' AND query_id % 2 = 0 THEN 1.5 ELSE 1 END * {1})) AS gain FROM {0} f JOIN both_ways b ON b.node = f.entity_id GROUP BY ALL"""
SQL = {
    "ontology_candidates": f"WITH {_PARTS} SELECT * FROM candidates", "ontology_relations": f"WITH {_PARTS} SELECT * FROM relations", "ontology_concepts": f"WITH {_PARTS} SELECT * FROM concepts",
    "ontology_entities": f"WITH {_GRAPH} SELECT * FROM entities", "ontology_aliases": f"WITH {_GRAPH} SELECT * FROM aliases", "ontology_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "ontology_hits": f"WITH {_HITS} SELECT * FROM hits",
    "ontology_expansion": f"""WITH {_HITS},
both_ways AS (SELECT src AS node, dst AS other, relation, weight FROM edges UNION ALL SELECT dst, src, relation, weight FROM edges),
start AS (SELECT query_id, entity_id FROM hits JOIN entities USING (entity_id) WHERE coalesce(status, '') <> 'candidate' UNION SELECT item_id, entity_id FROM benchmark JOIN bindings ON doc_id = item_id JOIN entities USING (entity_id) WHERE entity_type = 'document'),
one AS ({_STEP.format("start", 6)}), next AS (SELECT query_id, entity_id FROM one JOIN entities USING (entity_id) WHERE coalesce(status, '') <> 'candidate' EXCEPT SELECT * FROM start), two AS ({_STEP.format("next", 3)}),
boosts AS (SELECT query_id, doc_id, score AS b FROM hits JOIN bindings USING (entity_id) UNION ALL SELECT query_id, doc_id, gain FROM one JOIN bindings USING (entity_id) UNION ALL SELECT query_id, doc_id, gain FROM two JOIN bindings USING (entity_id))
SELECT query_id, doc_id, round(sum(b), 6) AS boost FROM boosts GROUP BY ALL""",
}
