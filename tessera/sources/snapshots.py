"""Versioned tables: rows in buckets by a hash of their key, and one small file that says which files are the table.

A change writes new files for the buckets that it touches and then a new version of the list; the name of the newest list is
the table's version. A writer that dies before its list is in place leaves the version before readable and whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Snapshots:
    """A table below a folder that driver and executors share: ``read``, ``write`` all rows, ``change`` some."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.Path(f"{self.folder}/versions"))

    def versions(self) -> list[int]:
        """Numbers of all versions there are, in order; a list that is still being written has another name."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _listed(self, version: int | None) -> dict[str, str]:
        """Bucket to folder of a version, the newest by default."""
        held = self.versions()
        if not held:
            return {}
        with_file = self.spark.read.option("wholetext", "true").text(f"{self.folder}/versions/{held[-1] if version is None else version}.json")
        return json.loads(with_file.first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; of a table without versions none."""
        return self._rows(sorted(set(self._listed(version).values())))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def _written(self, rows: DataFrame, touched: list[int], version: int) -> dict[str, str]:
        """New folders of the touched buckets; one without rows has none."""
        place = f"{self.folder}/data/{version}-{uuid.uuid4().hex}"
        # a bucket may be large, so rows are not gathered by bucket: each task writes a file a bucket
        rows.select(*self.schema.names).withColumn("bucket", self._bucket()).write.partitionBy("bucket").option("compression", "zstd").parquet(place)
        return {str(b): f"{place}/bucket={b}" for b in touched if self._fs.exists(self._path(f"{place}/bucket={b}"))}

    def _publish(self, listed: dict[str, str], version: int) -> int:
        """The list under a name of its own, then renamed; fails where another writer has published this version."""
        draft, final = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/versions/{version}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(listed, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ValueError(f"version {version} of {self.folder} is already there")
        return version

    def write(self, rows: DataFrame) -> int:
        """rows as the next version; returns its number."""
        version = (self.versions() or [0])[-1] + 1
        return self._publish(self._written(rows, list(range(self.buckets)), version), version)

    def change(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """The next version: rows take the place of those with their keys, keys of ``gone`` go. Only buckets with such keys are read and written.

        A key in both is kept with its new rows. Rows without a key are added and never replaced. A change without keys is no version.
        """
        keys = rows.select(self.key)
        keys = (keys if gone is None else keys.union(gone.select(self.key))).distinct()
        touched = sorted(r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        held = self.versions()
        if not touched:
            return (held or [0])[-1]
        version, listed = (held or [0])[-1] + 1, self._listed(None)
        old = self._rows([listed[str(b)] for b in touched if str(b) in listed])
        merged = old.join(keys, self.key, "left_anti").unionByName(rows.select(*self.schema.names))
        new = self._written(merged, touched, version)
        return self._publish({b: f for b, f in listed.items() if int(b) not in touched} | new, version)

    def update(self, values: DataFrame) -> int:
        """The next version: columns of rows whose key stands in ``values`` (one row a key) take its values; keys that no row has change nothing."""
        columns = [c for c in values.columns if c != self.key]
        new = values.select(self.key, *[F.col(c).alias(f"_new_{c}") for c in columns])
        touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())
        listed = self._listed(None)
        old = self._rows([listed[str(b)] for b in touched if str(b) in listed]).join(new, self.key)
        return self.change(old.select(*[F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in self.schema.names]))
