"""Token counts through a digest cache: only texts whose digest has no stored count are encoded.

The cache is a table of (digest, tokenizer, n_tokens). Digests of the normalised contents are joined to it, one text
of each missing digest is encoded, its count is appended, and all documents take their counts from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import free_name, shared_path, table, written
from tessera.llm.tokenizing import PieceEncoder

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def content(text: Column) -> Column:
    """The normalised content: null is the empty text; nothing else may change without changing counts."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    """A function from texts to numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    encoder = PieceEncoder.of(path)
    return lambda texts: [len(x) // 4 for x in encoder.ids(texts)]


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> str:
    """Appends to the cache the counts of docs' contents that it lacks; returns the tokenizer's version."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    # Makes the table where there is none yet; adds no rows.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).select("digest")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "tokenizer": version, "n_tokens": count(batch["content"].tolist())})
        if not tokenizer.endswith(".model"):
            PieceEncoder.of(tokenizer).forget()

    one_each = docs.select(content(F.col(text)).alias("content")).select(F.unhex(F.sha2("content", 256)).alias("digest"), "content").dropDuplicates(["digest"])
    one_each.join(stored, "digest", "left_anti").mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column ``out``: the tokens of each whole text, without special tokens added.

    cache is a folder that all executors share; it may hold counts from earlier runs, or not exist. A null text
    counts as the empty one, which has no tokens. Equal texts are encoded once and get one count, also where runs
    that append at once store a digest twice. An empty table stays empty; columns of docs stay, one named ``out`` is
    replaced.
    """
    version = fill_cache(docs, cache, tokenizer, text)
    digest = free_name(docs, "digest")
    stored = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).dropDuplicates(["digest"])
    # A table of its own, so that both sides of the join are plain exchanges and a hot digest is split.
    counts = written(stored.select(F.col("digest").alias(digest), F.col("n_tokens").alias(out)), "token-counts")
    keyed = docs.drop(out) if text != out else docs
    return keyed.withColumn(digest, F.unhex(F.sha2(content(F.col(text)), 256))).join(counts, digest, "left").drop(digest)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document counted, with a cache that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.octet_length(content(F.col("text"))).cast("long"))
    counted = count_tokens(sized, shared_path(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
