"""Rules, gates and list operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules as U
from tessera.operators import gates as G
from tessera.operators import retrieval as R
from tessera.plans import retrieval_queries as Q
from tessera.sources.tables import table


def page_metadata(spark, sf):
    """Mode, type, group, role and chunk policy of every page, from the last piece of its address and the address itself."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.element_at(F.split(F.coalesce("url", F.lit("")), "/", -1), -1).alias("name"))
    return U.metadata(pages).select("page_id", "name", "title", "mode", "source_type", "document_group", "source_role", "chunk_policy", "effective_date")


def turn_signals(spark, sf):
    """Of every turn: does it try to overrule instructions, ask for a procedure, qualify what it says."""
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", U.injection_signal(t).alias("injection"), U.asks_for_procedure(t).alias("procedure"), F.array_join(U.qualifiers(t), ",").alias("qualifiers"),
        F.size(U.compound_variants(t)).alias("n_variants"), F.md5(U.law_text(t)).alias("law_md5"),
    )


def agent_decisions(spark, sf):
    """What an agent does with every question, from its confidence and its candidates."""
    return Q.question_outcomes(spark, sf).select("query_id", "confidence", U.agent_decision(F.col("confidence"), F.col("n_candidates")).alias("decision"))


def embedding_readiness(spark, sf):
    """By source: documents, those with a vector under their id, their share, and what retrieval it allows."""
    docs, held = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct()
    by = docs.join(held.withColumn("has", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_embedded"))
    return by.select("source", "n", "n_embedded", G.ratio(F.col("n_embedded"), F.col("n")).alias("coverage"), U.readiness(F.col("n_embedded"), F.col("n")).alias("readiness"))


def list_overlaps(spark, sf):
    """How far the exact list of each question agrees with its lexical list."""
    docs, asked = Q._docs(spark, sf), Q._questions(spark, sf)
    return G.list_overlap(R.exact(docs, asked), R.lexical(docs, asked))


def unique_sources(spark, sf):
    """The best document of each source in every fused list."""
    ranked = Q.hybrid_fused(spark, sf).select("query_id", "doc_id", "rank").join(Q._docs(spark, sf).select("doc_id", "source"), "doc_id")
    return G.first_of_each(ranked, "source").select("query_id", "source", "doc_id", "rank")


def merged_best(spark, sf):
    """Exact and lexical lists in one: of a document found by both, the better score."""
    docs, asked = Q._docs(spark, sf), Q._questions(spark, sf)
    lists = [df.select("query_id", "doc_id", "score", F.lit(n).alias("list")) for n, df in (("exact", R.exact(docs, asked)), ("lexical", R.lexical(docs, asked)))]
    return G.best_of_each(lists[0].unionByName(lists[1]), "score", "query_id", "doc_id")


def miss_classes(spark, sf):
    """Questions by what became of the document that holds them: hit, or the class of the miss."""
    docs, asked = Q._docs(spark, sf), Q._questions(spark, sf)
    exact = R.exact(docs, asked)
    first = exact.filter("rank = 1").select("query_id", F.col("doc_id").alias("expected"))
    fused = R.fused({"lexical": R.lexical(docs, asked), "exact": exact})
    place = fused.join(first, "query_id").filter("doc_id = expected").select("query_id", "rank")
    cases = Q.question_outcomes(spark, sf, fused).select("query_id", "confidence").join(first, "query_id", "left").join(place, "query_id", "left")
    rank = F.coalesce("rank", F.lit(999))
    top3, top5 = rank <= 3, rank <= 5
    kind = F.when(top3, "hit").otherwise(G.miss_class(top3, top5, F.col("expected").isNull(), F.col("confidence"), rank < 999))
    return cases.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def log_reviews(spark, sf):
    """Users by the review signals of their events: errors stand for issues, purchases for fallbacks, large values for claims without support."""
    e = table(spark, sf, "events")
    kind, value = F.coalesce("event_type", F.lit("")), F.coalesce("value", F.lit(0.0))
    marked = e.select("user_id", G.review_signals(F.when(value < 10, "low").otherwise("high"), (kind == "error").cast("int"), (value > 90).cast("int"), kind == "purchase", F.col("event_id") % 5 == 0, F.lit("evaluation")).alias("signals"))
    return marked.select("user_id", F.explode("signals").alias("signal")).groupBy("user_id", "signal").agg(F.count(F.lit(1)).alias("n"))


def latest_events(spark, sf):
    """The 50 newest events, newest first."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return G.latest(e, 50, F.desc("event_id"))


QUERIES = {f.__name__: f for f in (page_metadata, turn_signals, agent_decisions, embedding_readiness, list_overlaps, unique_sources, merged_best, miss_classes, log_reviews, latest_events)}

_ANY = lambda words, at: " OR ".join(f"contains({at}, '{w}')" for w in words)
_KINDS = " ".join(f"WHEN {_ANY(words, 'lower(name)')} THEN '{kind}'" for kind, words in U.SOURCE_TYPES)
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_SQUEEZED = r"lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))"
_HELD = lambda words: " OR ".join(f"contains(q, '{''.join(w.split()).lower()}')" for w in words)
_VARIANTS = ", ".join(f"CASE WHEN {_HELD((c, *v))} THEN [{', '.join(repr(x) for x in v)}] ELSE [] END" for c, v in U.COMPOUNDS.items())
_QUAL = ", ".join(f"CASE WHEN regexp_matches(text, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}' END" for k, ps in U.QUALIFIERS.items())
_WITH = f"WITH {Q._FUSED}"
_OUTCOMES = f"""{_WITH},
best AS (SELECT query_id, count(*) AS n, max(exact_score) AS exact, max(lexical_score) AS lexical FROM fused_list GROUP BY query_id),
s AS (SELECT item_id AS query_id, coalesce(n, 0) AS n_candidates, coalesce(exact, 0) * 1.8::DOUBLE + coalesce(lexical, 0) * 15 AS score FROM benchmark LEFT JOIN best ON item_id = query_id),
o AS (SELECT *, CASE WHEN score >= 72 THEN 'high' WHEN score >= 42 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'none' END AS confidence FROM s)"""
SQL = {
    "page_metadata": rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS path, list_last(string_split(coalesce(url, ''), '/')) AS name FROM pages),
t AS (SELECT *, regexp_replace(name, '(?i)\.(md|txt)$', '') AS title, CASE WHEN regexp_matches(path, '/knowledge/(eval|evaluation)/') THEN 'evaluation' ELSE 'integrated' END AS mode,
  CASE {_KINDS} WHEN contains(path, '/knowledge/evaluation/') THEN 'evaluation' WHEN {_ANY(U.MANUAL, 'lower(name)')} THEN 'manual' ELSE 'other' END AS source_type FROM p),
g AS (SELECT *, CASE WHEN source_type IN {_IN(U.LEGAL_TYPES)} THEN 'legal' WHEN source_type IN ('qa','manual','comparison','wiki','guide','evaluation') THEN source_type
  WHEN contains(lower(name), '평가') THEN 'evaluation' ELSE 'general' END AS document_group FROM t)
SELECT page_id, name, title, mode, source_type, document_group,
  CASE WHEN source_type IN {_IN(U.SUPPORT_TYPES)} THEN 'support_reference' WHEN mode = 'evaluation' THEN 'primary_evaluation' ELSE 'general' END AS source_role,
  CASE WHEN source_type IN {_IN(U.LEGAL_TYPES)} OR regexp_matches(title || ' ' || name || ' ' || path, '{U.LEGAL_TITLE}') THEN 'law'
       WHEN document_group = 'evaluation' OR regexp_matches(title || ' ' || name || ' ' || path, '{U.EVALUATION_TITLE}') THEN 'evaluation'
       WHEN source_type IN ('qa', 'comparison') THEN source_type WHEN source_type IN ('manual', 'guide') THEN 'manual' ELSE 'general' END AS chunk_policy,
  CASE WHEN regexp_matches(name, '{U.DATE}') THEN regexp_replace(regexp_extract(name, '{U.DATE}'), '{U.DATE}', '\1-\2-\3') END AS effective_date
FROM g""",
    "turn_signals": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_SQUEEZED} AS q FROM conversations)
SELECT conv_id, turn, {' OR '.join(f"regexp_matches(text, '{p}')" for p in U.INJECTION)} AS injection, {_HELD(U.PROCEDURE)} AS procedure,
  coalesce(array_to_string(list_filter([{_QUAL}], lambda x: x IS NOT NULL), ','), '') AS qualifiers, len(list_distinct(flatten([{_VARIANTS}])))::INT AS n_variants,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{a0}}\x{{2002}}\x{{2003}}\x{{2009}}]', ' ', 'g'), '[\x{{2010}}-\x{{2015}}]', '-', 'g'),
    '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'), '제\s+([0-9]+)\s+([조항호목])', '제\1\2', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'))) AS law_md5 FROM c""",
    "agent_decisions": f"{_OUTCOMES} SELECT query_id, confidence, CASE WHEN n_candidates <= 0 OR confidence = 'low' THEN 'abstain' ELSE 'answer' END AS decision FROM o",
    "embedding_readiness": """
WITH b AS (SELECT source, count(*) AS n, count(v) AS n_embedded FROM documents LEFT JOIN (SELECT DISTINCT vec_id AS v FROM embeddings) ON v = doc_id GROUP BY source)
SELECT source, n, n_embedded, round(n_embedded / n, 3) AS coverage, CASE WHEN n_embedded <= 0 THEN 'lexical_only' WHEN n_embedded / n >= 0.9 THEN 'hybrid_ready' ELSE 'hybrid_partial' END AS readiness FROM b""",
    "list_overlaps": f"""{_WITH}, u AS (SELECT coalesce(e.query_id, l.query_id) AS query_id, e.doc_id AS e, l.doc_id AS l FROM exa e FULL JOIN lex l USING (query_id, doc_id))
SELECT query_id, count(e) AS n_left, count(l) AS n_right, count(CASE WHEN e IS NOT NULL THEN l END) AS n_both,
  CASE WHEN count(e) > 0 THEN round(count(CASE WHEN e IS NOT NULL THEN l END) / count(e), 3) ELSE 0 END AS coverage FROM u GROUP BY query_id""",
    "unique_sources": f"""{_WITH}, j AS (SELECT query_id, source, doc_id, rank FROM fused_list JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM j""",
    "merged_best": f"""{_WITH}, u AS (SELECT query_id, doc_id, score, 'exact' AS list FROM exa UNION ALL SELECT query_id, doc_id, score, 'lexical' FROM lex)
SELECT query_id, doc_id, score, list FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, list) = 1""",
    "miss_classes": f"""{_OUTCOMES},
x AS (SELECT query_id, doc_id AS expected FROM exa WHERE rank = 1),
c AS (SELECT o.query_id, confidence, expected, coalesce(f.rank, 999) AS rank FROM o LEFT JOIN x USING (query_id) LEFT JOIN fused_list f ON f.query_id = o.query_id AND f.doc_id = expected)
SELECT CASE WHEN rank <= 3 THEN 'hit' WHEN expected IS NULL AND confidence = 'low' AND rank > 5 THEN 'accepted-abstain-negative-case' WHEN rank <= 5 THEN 'top3-rerank-priority-miss'
  WHEN rank < 999 THEN 'evidence-visible-fusion-miss' ELSE 'candidate-recall-miss' END AS outcome, count(*) AS n FROM c GROUP BY ALL""",
    "log_reviews": """
WITH e AS (SELECT user_id, event_id, coalesce(event_type, '') AS k, coalesce(value, 0) AS v FROM events),
s AS (SELECT user_id, unnest(list_filter([CASE WHEN v < 10 THEN 'low_confidence' END, CASE WHEN k = 'error' THEN 'validation_issue' END, CASE WHEN v > 90 THEN 'unsupported_claim' END,
  CASE WHEN k = 'purchase' THEN 'fallback_used' END, CASE WHEN event_id % 5 = 0 THEN 'rank_evidence_gap' END,
  CASE WHEN event_id % 5 = 0 OR k = 'error' OR v > 90 THEN 'residual_ranking_candidate' END], lambda x: x IS NOT NULL)) AS signal FROM e)
SELECT user_id, signal, count(*) AS n FROM s GROUP BY ALL""",
    "latest_events": "SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS place FROM events QUALIFY place <= 50",
}
