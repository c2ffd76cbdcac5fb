"""Manifests of indexed files: build, hash, diff, incremental upsert, data-quality issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import whole
from tessera.operators.sections import OVERSIZED


def manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, source, content_hash, size, chunk_count): files left-joined to their numbers of chunks."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    entries = files.select("doc_id", "source", F.sha2(whole(F.col("text")), 256).alias("content_hash"), F.octet_length(whole(F.col("text"))).cast("long").alias("size"))
    return entries.join(counts, "doc_id", "left").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", "source", "content_hash", "size", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count")
    )


def fingerprint(entries: DataFrame, per: str = "source") -> DataFrame:
    """A hash of each group's entries that no order of rows changes: the xor of the entries' hashes, and their number."""
    return entries.groupBy(per).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.sha2(F.concat_ws(":", "path", "content_hash", "size", "chunk_count"), 256), 1, 15), 16, 10).cast("long")).alias("hash"))


def diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, status): missing in the index, orphaned in it, or stale where hash, size or chunk count differ."""
    fields = ("content_hash", "size", "chunk_count")
    left = disk.select("path", F.struct(*fields).alias("d"))
    right = index.select("path", F.struct(*fields).alias("i"))
    both = left.join(right, "path", "full_outer")
    status = F.when(F.col("i").isNull(), "missing").when(F.col("d").isNull(), "orphaned").when(F.col("d") != F.col("i"), "stale")
    return both.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def upserted(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target without the changed keys, then the changes: what a delete-and-insert leaves."""
    return target.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def issues(files: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(code, doc_id, detail): empty documents, NUL characters, contents that occur twice, oversized sections."""
    text = whole(F.col("text"))
    hashed = files.select("doc_id", F.sha2(text, 256).alias("h"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("flat"), text.contains("\u0000").alias("nul"))
    copies = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = hashed.join(copies, "h").select(F.lit("duplicate-content").alias("code"), "doc_id", F.col("n").cast("long").alias("detail"))
    empty = hashed.filter("flat = ''").select(F.lit("empty-document").alias("code"), "doc_id", F.lit(0).cast("long").alias("detail"))
    nul = hashed.filter("nul").select(F.lit("nul-stripped").alias("code"), "doc_id", F.lit(1).cast("long").alias("detail"))
    large = section_rows.groupBy("doc_id").agg(F.count(F.when(F.length("content") > OVERSIZED, 1)).alias("detail")).filter("detail > 0").select(F.lit("oversized-section").alias("code"), "doc_id", "detail")
    return same.unionByName(empty).unionByName(nul).unionByName(large)
