"""Tables that change by bucket: versions in a manifest, so writers rewrite what they touch and one of two wins.

A table lies in folders of one bucket each.  A change writes new folders for the buckets it touches and
then a manifest, a small file named by its version, that says which folders hold the buckets now.  The
manifest's file must not exist yet, so of two writers that start from one version the second gets
``Conflict`` (as sure as the file system's create is; HDFS's is atomic) and may begin again from the new
version.  Readers keep the version they began with until ``vacuum`` takes its folders away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
RETRIES = 5


class Conflict(RuntimeError):
    """Another writer made this version."""


class Manifest:
    """Versions 1, 2, ... of a dictionary in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("manifest")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(f.getPath().getName()[1:]) for f in found if f.getPath().getName()[:1] == "v")

    def load(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"manifest/v{version:010d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """(version, content); (0, {}) where there is none."""
        versions = self.versions()
        return (versions[-1], self.load(versions[-1])) if versions else (0, {})

    def commit(self, version: int, content: dict) -> None:
        """The next version; ``Conflict`` if it is there."""
        try:
            stream = self._fs.create(self._at(f"manifest/v{version:010d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {version} of {self.path}") from e
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def write(self, rows: DataFrame, bucket: str, *spread: Column) -> dict[str, str]:
        """Folder, below the table's own, of each bucket that ``rows`` have; one shuffle, by bucket and ``spread``."""
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition(bucket, *spread).write.partitionBy(bucket).parquet(f"{self.path}/{name}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(name))]
        return {n.rpartition("=")[2]: f"{name}/{n}" for n in names if "=" in n}

    def read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def vacuum(self, keep: int = 1, named: Callable[[dict], list[str]] | None = None) -> None:
        """Takes away all but the last ``keep`` versions, and the folders that only versions before those name.

        Folders that no version names are left alone: a writer may be about to commit them.
        """
        named = named or (lambda content: list(content["folders"].values()))
        versions = self.versions()
        live = {f for v in versions[-keep:] for f in named(self.load(v))}
        for v in versions[:-keep]:
            gone = set(named(self.load(v))) - live
            for f in gone:
                self._fs.delete(self._at(f), True)
            for batch in {f.rpartition("/")[0] for f in gone} - {f.rpartition("/")[0] for f in live}:
                self._fs.delete(self._at(batch), True)
            self._fs.delete(self._at(f"manifest/v{v:010d}"), False)


class VersionedTable:
    """Rows by key: ``upsert`` puts rows in the place of those of the same key, ``delete`` takes keys out.

    Keys may be null.  Of rows of a batch that share a key the greatest (column by column) counts.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        """A table in use keeps its own number of buckets."""
        self.spark, self.keys, self.manifest = spark, keys, Manifest(spark, path)
        self.buckets = self.manifest.last()[1].get("buckets", buckets)

    @property
    def version(self) -> int:
        return self.manifest.last()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless given."""
        held = self.manifest.load(version) if version else self.manifest.last()[1]
        if not held:
            raise ValueError("nothing was written yet")
        return self.manifest.read(list(held["folders"].values()), T.StructType.fromJson(held["schema"]))

    def upsert(self, rows: DataFrame) -> int:
        """The version in which the rows stand."""
        others = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*others)).alias("nf_rest")).select(*self.keys, "nf_rest.*") if others else rows.distinct()
        return self._change(one.select(*rows.columns), lambda old, new: self._without(old, new).unionByName(new))

    def delete(self, keys: DataFrame) -> int:
        """The version without these keys (columns ``keys``)."""
        return self._change(keys.select(*self.keys).distinct(), self._without)

    def _without(self, old: DataFrame, new: DataFrame) -> DataFrame:
        same = [old[k].eqNullSafe(new[k]) for k in self.keys]
        return old.join(new, same, "left_anti")

    def _change(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrites the buckets that ``rows`` touch, anew if another writer was faster."""
        path = f"{self.manifest.path}/incoming-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [str(r[0]) for r in rows.select(bucket).distinct().collect()]  # at most a row per bucket
        for _ in range(RETRIES):
            version, held = self.manifest.last()
            if version and held["buckets"] != self.buckets:
                raise Conflict("another writer chose other buckets")
            schema = T.StructType.fromJson(held["schema"]) if version else rows.schema
            folders = held.get("folders", {})
            old = self.manifest.read([folders[b] for b in touched if b in folders], schema)
            new = self.manifest.write(merged(old, rows).withColumn("nf_bucket", bucket), "nf_bucket")
            kept = {b: f for b, f in folders.items() if b not in touched}
            try:
                self.manifest.commit(version + 1, {"buckets": self.buckets, "schema": schema.jsonValue(), "folders": kept | new})
            except Conflict:
                continue
            self.manifest._fs.delete(self.manifest._at(path.rpartition("/")[2]), True)
            return version + 1
        raise Conflict(f"{RETRIES} other writers were faster")

    def vacuum(self, keep: int = 1) -> None:
        """Only the last ``keep`` versions stay."""
        self.manifest.vacuum(keep)
