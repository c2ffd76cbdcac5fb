"""Sinks: keyed upserts, embedding caches, JSON manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import usable
from tessera.operators.manifest import upserted


def write_upsert(target: DataFrame, changes: DataFrame, key: str, path: str) -> None:
    """The target with changed keys replaced, written to another path: a table is never read and overwritten at once."""
    upserted(target, changes, key).write.mode("overwrite").parquet(path)


def write_embedding_cache(chunks: DataFrame, path: str, dims: int) -> None:
    """(chunk_hash, embedding) of chunks whose vector has exactly ``dims`` finite components."""
    chunks.filter(usable(F.col("embedding"), dims)).select("chunk_hash", "embedding").dropDuplicates(["chunk_hash"]).write.mode("overwrite").parquet(path)


def restored(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with a cached vector where they have none of their own."""
    held = cache.select("chunk_hash", F.col("embedding").alias("_cached"))
    return chunks.join(held, "chunk_hash", "left").withColumn("embedding", F.coalesce("embedding", "_cached")).drop("_cached")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
