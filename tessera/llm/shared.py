"""Helpers the operators share: the cluster's shared folder, words, literals."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of texts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the setting is absent, a single-machine session gets a temporary folder of its own;
    on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there and no executor owns it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path_written = path
    return out


def erase(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned, once every table made from them is written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.path_written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else, so that lengths and offsets stay."""
    return F.translate(col, UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """base, lengthened until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = f"_{base}"
    return base


def with_struct(df: DataFrame, name: str, struct: Column) -> DataFrame:
    """df with a struct that is computed once a row: filters on it stay above the generator and copy no expression."""
    own = free_name(df, f"_{name}")
    return df.select("*", F.explode(F.array(struct)).alias(own)).drop(name).withColumnRenamed(own, name)
