"""Documents as an index of before, with changes laid over it: other languages' texts, taken away, and added anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import overlay as O
from tessera.plans import retrieval_queries as Q
from tessera.plans.text_queries import TOKENS_SQL
from tessera.sources.tables import spread, stored, table

#: Both engines read this expression: a document's text after the changes, null where it is taken away.
_CHANGED = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN concat(substr(text, 1, 200), ' added words anew') ELSE text END"


def _state(spark, sf):
    """The base: postings, frequencies and number of all documents but each seventh; changes: every row of two residues, twice, the later one right; sevenths are added."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    base = spread(docs.filter("doc_id % 7 <> 0"))
    changes = docs.filter("doc_id % 5 < 2 OR doc_id % 7 = 0")
    wrong = changes.select("doc_id", F.lit("words that do not count").alias("text"), F.lit(1).alias("seq"))
    delta = O.current(changes.selectExpr("doc_id", f"{_CHANGED} AS text", "2 AS seq").unionByName(wrong))
    return base, stored(I.postings(base, "doc_id", "text"), "overlay-postings"), stored(delta, "overlay-changes")


def overlay_frequencies(spark, sf):
    _, posted, delta = _state(spark, sf)
    return O.frequencies(I.document_frequency(posted), O.frequency_change(posted, delta))


def overlay_lists(spark, sf):
    """What follows the base's index looks at postings of tokens that a question holds alone."""
    base, posted, delta = _state(spark, sf)
    asked = Q._questions(spark, sf)
    own, new = O.asked_for(posted, asked), stored(O.asked_for(O.added(spread(delta)), asked), "overlay-added")
    df = O.frequencies(I.document_frequency(own), O.frequency_change(own, delta, new))
    return O.search(O.posted_after(own, delta, new), df, O.overlaid(base, delta).count(), asked)


QUERIES = {f.__name__: f for f in (overlay_frequencies, overlay_lists)}

_NOW = f"changed AS (SELECT doc_id, {_CHANGED} AS text FROM documents), corpus AS (SELECT * FROM changed WHERE doc_id % 5 <> 0)"
SQL = {
    "overlay_frequencies": f"WITH {_NOW}, t AS (SELECT unnest({TOKENS_SQL.format('text')}) AS token FROM corpus) SELECT token, count(*) AS df FROM t GROUP BY token",
    "overlay_lists": f"WITH {_NOW}, {Q._LEX.replace('documents', 'corpus')} SELECT query_id, doc_id, score, n_matched, rank FROM lex",
}
