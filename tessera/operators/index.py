"""The token index: postings, document frequencies, inverse document frequencies, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n_tokens): a row for each distinct token of a text; n_tokens is their number in it."""
    # behind a generator, so that the two readers of the list don't each make it
    listed = corpus.select(F.col(key), F.explode(F.array(tokens(F.col(text)))).alias("tokens"))
    return listed.select(key, F.explode("tokens").alias("token"), F.size("tokens").alias("n_tokens"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(token, df). Postings hold a token once a text, so a count is enough and combines before the shuffle."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(df, n):
    """ln((n + 1) / (df + 1)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def corpus_stats(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """One row: texts, distinct tokens, postings, mean tokens a text, the largest document frequency."""
    posted = postings(corpus, key, text)
    by_token = document_frequency(posted).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"), F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("n_singletons")
    )
    return by_token
