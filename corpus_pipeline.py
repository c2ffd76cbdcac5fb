"""A training corpus from documents: quality rules, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_copies, packing, quality_rules, substring_dedup
from tessera.llm.shared import free_name, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the target is what labels call good.

    Null, empty and short texts go; very long ones are judged whole; repeated rows and ties get equal verdicts. An empty table stays
    empty. All columns are returned as they are, whatever their names.
    """
    out = free_name(docs, "quality")
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), out=out).filter(F.col(f"{out}.kept")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    SimHash look-ups give the close candidates. Texts of that similarity can differ in 5 to 10 bits, beyond what look-ups find, so
    a prefix filter gives the rest; all are held against whole texts. Null and empty texts are one group; the
    smallest id stays, of equal rows one. An empty table stays empty. All columns are returned as they are, whatever their names.
    """
    return near_copies.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier document has; one left without text stays, empty.

    A null text stays null, with null n_chars; the smallest id comes first, of equal ids a hash decides; rows equal in id and text are
    one document. Very long texts are cut whole. An empty table stays empty. Other columns are returned as they are, whatever their names.
    """
    out = free_name(docs, "dedup")
    clean = substring_dedup.dedup(docs, out=out)
    return clean.withColumn("text", F.col(f"{out}.text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, dealt to shards and shuffled in them.

    Null and empty texts have no words and follow their block; a null source is one, the last; ties are broken by
    hash, repeated rows are taken together. An empty table stays empty. All columns are returned as they are, whatever their names.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens.

    A null or empty text is one token; longer documents than a sequence are cut; repeated rows and null ids are packed
    like any other. An empty table gives no pieces. Only doc_id and text are read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hash-based and iterative stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder, which the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
