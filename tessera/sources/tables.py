"""Table sources: parquet tables of a data folder, knowledge files, JSON manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the folder that spark.checkpoint.dir names, which driver and executors share: what several readers need is made once.

    A session on one machine that has no such setting gets a temporary folder; on a cluster the setting is required.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small file gives fewer partitions than that; a table of many files stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, content, updated_at, nul_stripped, mode) of all .md and .txt files below a folder.

    Files under an ``eval`` or ``evaluation`` folder have mode evaluation; files and folders that begin with a dot are
    left out; NUL characters are removed and remembered.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").load(folder)
    text = F.decode("content", "UTF-8")
    nul = F.lit("\u0000")
    return raw.filter(~F.col("path").rlike(r"/\.[^/]+")).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.replace(text, nul, F.lit("")).alias("content"),
        F.col("modificationTime").alias("updated_at"), text.contains("\u0000").alias("nul_stripped"),
        F.when(F.col("path").rlike("/(eval|evaluation)/"), "evaluation").otherwise("integrated").alias("mode"),
    )


LEXICON = T.StructType([
    T.StructField("expression", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("slot_hint", T.StringType()), T.StructField("mode_scope", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("status", T.StringType()),
])


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon entries of a JSON file, the rejected left out."""
    return spark.read.schema(LEXICON).option("multiLine", "true").json(path).filter("coalesce(status, '') <> 'rejected'")


def string_array(col):
    """A JSON array of strings; what is no JSON is split at ``>``; null is empty."""
    parts = F.filter(F.transform(F.split(col, ">"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(col, T.ArrayType(T.StringType()), {"mode": "PERMISSIVE"}), parts, F.array().cast("array<string>"))


def embedding(col):
    """A JSON array of numbers; null where it is none."""
    return F.from_json(col, T.ArrayType(T.DoubleType()))


def number(col):
    """A finite number, 0 for anything else."""
    x = F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)
