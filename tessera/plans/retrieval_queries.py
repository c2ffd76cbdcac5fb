"""Retrieval over documents, with benchmark texts as questions, and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators.index import corpus_stats, document_frequency, postings
from tessera.plans.text_queries import TOKENS_SQL
from tessera.sources.tables import spread, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def lexical_top_k(spark, sf):
    return R.lexical(_docs(spark, sf), _questions(spark, sf))


def exact_matches(spark, sf):
    return R.exact(_docs(spark, sf), _questions(spark, sf))


def vector_neighbours(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = R.vector(rows.select(F.col("vec_id").alias("doc_id"), "embedding"), rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.withColumn("score", F.round("score", 6))


def hybrid_fused(spark, sf):
    docs, asked = _docs(spark, sf), _questions(spark, sf)
    return R.fused({"lexical": R.lexical(docs, asked), "exact": R.exact(docs, asked)})


def hybrid_three_lists(spark, sf):
    """Lexical, exact and vector lists fused: a document's and a question's vectors are those of their numbers in embeddings."""
    docs, asked, rows = _docs(spark, sf), _questions(spark, sf), table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = R.vector(docs.select("doc_id").join(rows.withColumnRenamed("vec_id", "doc_id"), "doc_id"), asked.select("query_id").join(rows.withColumnRenamed("vec_id", "query_id"), "query_id"))
    return R.fused({"lexical": R.lexical(docs, asked), "exact": R.exact(docs, asked), "vector": near.withColumn("score", F.round("score", 6))})


def diversified(spark, sf):
    """The fused lists with at most two of a source in front; the others go behind."""
    return R.capped(hybrid_fused(spark, sf).join(_docs(spark, sf).select("doc_id", "source"), "doc_id"), "source", 2, defer=True).select("query_id", "doc_id", "source", "rank", "deferred")


def question_outcomes(spark, sf, fused=None):
    """A row a question: best scores and how far they can be trusted; from ``fused`` where the lists are there already."""
    best = (hybrid_fused(spark, sf) if fused is None else fused).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("exact_score").alias("exact"), F.max("lexical_score").alias("lexical"))
    score = F.coalesce("exact", F.lit(0.0)) * 1.8 + F.coalesce("lexical", F.lit(0.0)) * 15
    asked = _questions(spark, sf).select("query_id")
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"), F.round(score, 6).alias("score"), R.confidence(score).alias("confidence"))


def index_statistics(spark, sf):
    return corpus_stats(spread(_docs(spark, sf)), "doc_id", "text")


def token_frequencies(spark, sf):
    return document_frequency(postings(spread(_docs(spark, sf)), "doc_id", "text"))


QUERIES = {f.__name__: f for f in (lexical_top_k, exact_matches, vector_neighbours, hybrid_fused, hybrid_three_lists, diversified, question_outcomes, index_statistics, token_frequencies)}

_POSTINGS = f"""
t AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS token, len(t) AS n_tokens FROM t),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
qt AS (SELECT item_id AS query_id, text AS question, {TOKENS_SQL.format("text")} AS t FROM benchmark),
q AS (SELECT query_id, unnest(t) AS token FROM qt)"""
_LEX = f"""{_POSTINGS},
scored AS (
  SELECT query_id, doc_id, round(sum((ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) / n_tokens), 9) AS score, count(*) AS n_matched
  FROM q JOIN p USING (token) JOIN f USING (token) GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 24)"""
_COMPACT = r"regexp_replace(lower(coalesce({0}, '')), '[^\x{{ac00}}-\x{{d7a3}}\x{{1100}}-\x{{11ff}}\x{{3130}}-\x{{318f}}0-9a-z]+', '', 'g')"
_EXACT = f"""
wordings AS (SELECT item_id AS query_id, text AS question, {_COMPACT.format("text")} AS wanted FROM benchmark),
compacted AS (SELECT doc_id, coalesce(text, '') AS text, {_COMPACT.format("text")} AS c FROM documents),
hit AS (SELECT o.query_id, d.doc_id, 28.0::DOUBLE + CASE WHEN contains(d.text, o.question) THEN 12 ELSE 0 END AS score
  FROM wordings o JOIN compacted d ON length(o.wanted) >= 2 AND contains(d.c, o.wanted)),
exa AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 24)"""
_FUSED = f"""{_LEX}, {_EXACT},
lists AS (SELECT query_id, doc_id, 'lexical' AS list, score, rank FROM lex UNION ALL SELECT query_id, doc_id, 'exact', score, rank FROM exa),
summed AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (50 + rank)), 9) AS fused, count(*) AS n_lists,
  max(score) FILTER (list = 'lexical') AS lexical_score, max(score) FILTER (list = 'exact') AS exact_score FROM lists GROUP BY ALL),
fused_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM summed QUALIFY rank <= 24)"""
SQL = {
    "lexical_top_k": f"WITH {_LEX} SELECT * FROM lex",
    "exact_matches": f"WITH {_EXACT} SELECT * FROM exa",
    "vector_neighbours": """
WITH pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE score > 0 QUALIFY rank <= 48)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""",
    "hybrid_fused": f"WITH {_FUSED} SELECT * FROM fused_list",
    "hybrid_three_lists": f"""WITH {_LEX}, {_EXACT},
cosines AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN (embeddings d JOIN documents ON d.vec_id = doc_id) ON q.vec_id <> d.vec_id),
vec AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM cosines WHERE score > 0 QUALIFY rank <= 48),
lists AS (SELECT query_id, doc_id, 'lexical' AS list, score, rank FROM lex UNION ALL SELECT query_id, doc_id, 'exact', score, rank FROM exa UNION ALL SELECT * FROM (SELECT query_id, doc_id, 'vector', score, rank FROM vec)),
summed AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (50 + rank)), 9) AS fused, count(*) AS n_lists, max(score) FILTER (list = 'lexical') AS lexical_score, max(score) FILTER (list = 'exact') AS exact_score, max(score) FILTER (list = 'vector') AS vector_score FROM lists GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM summed QUALIFY rank <= 24""",
    "diversified": f"""WITH {_FUSED},
marked AS (SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS deferred FROM fused_list JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS rank, deferred FROM marked""",
    "question_outcomes": f"""WITH {_FUSED},
best AS (SELECT query_id, count(*) AS n, max(exact_score) AS exact, max(lexical_score) AS lexical FROM fused_list GROUP BY query_id),
s AS (SELECT item_id AS query_id, coalesce(n, 0) AS n_candidates, coalesce(exact, 0) * 1.8::DOUBLE + coalesce(lexical, 0) * 15 AS score FROM benchmark LEFT JOIN best ON item_id = query_id)
SELECT query_id, n_candidates, round(score, 6) AS score, CASE WHEN score >= 72 THEN 'high' WHEN score >= 42 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'none' END AS confidence FROM s""",
    "index_statistics": f"WITH {_POSTINGS} SELECT count(*) AS n_tokens, sum(df)::BIGINT AS n_postings, max(df) AS max_df, count(*) FILTER (df = 1) AS n_singletons FROM f",
    "token_frequencies": f"WITH {_POSTINGS} SELECT token, df FROM f",
}
