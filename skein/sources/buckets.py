"""Keyed tables on shared storage that change as a whole: rows lie in hash buckets, a manifest names each bucket's folder, and a
change writes new folders for the buckets that it touches and then a new manifest.

A manifest is a small file of the next number, created only if there is none of that number yet; readers take the largest. So
a change is seen whole or not at all, a job that dies midway leaves the table as it was, and of two changes at once one fails.
Folders that no manifest names any more are left to `vacuum`.

Defined results: rows with a null key share one bucket; a key may have many rows; an upsert with several rows of a key keeps
them all; an empty change makes a new version with the same rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was made meanwhile."""


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        place = self._at("manifests")
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def _manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version}").first()["value"]) | {"version": version}

    def _commit(self, version: int, manifest: dict) -> None:
        place = self._at("manifests", str(version))
        if self._files.exists(place):
            raise Conflict(f"version {version} of {self.path} exists")
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._files.mkdirs(self._at("manifests"))
        if not self._files.rename(draft, place):  # a rename is seen whole or not at all
            raise Conflict(f"version {version} of {self.path} exists")

    def _bucketed(self, rows: DataFrame, key: str, buckets: int) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows with their buckets to a new folder; the buckets that are there and their folders."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._files.listStatus(self._at(folder)) if s.isDirectory()]
        return {name.split("=")[1]: f"{folder}/{name}" for name in found if name.startswith(f"{_BUCKET}=")}

    def create(self, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        folders = self._written(self._bucketed(rows, key, buckets))
        self._commit(1, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": folders})

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest); of some buckets only, if these are given."""
        manifest = self._manifest(version)
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f for b, f in sorted(manifest["folders"].items()) if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """Takes out all rows of the keys and puts in the new rows. Only buckets with such keys or rows are read and written."""
        manifest = self._manifest()
        key, n = manifest["key"], manifest["buckets"]
        gone, new = self._bucketed(keys.select(key).distinct(), key, n), self._bucketed(rows.select(*[f["name"] for f in json.loads(manifest["schema"])["fields"]]), key, n)
        touched = [r[0] for r in gone.select(_BUCKET).union(new.select(_BUCKET)).distinct().collect()]  # at most as many as buckets
        old = self._bucketed(self.read(manifest["version"], touched), key, n)
        at = F.col(f"o.{key}").eqNullSafe(F.col(f"g.{key}")) & (F.col(f"o.{_BUCKET}") == F.col(f"g.{_BUCKET}"))
        kept = old.alias("o").join(gone.alias("g"), at, "left_anti")
        folders = self._written(kept.unionByName(new))
        rest = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
        self._commit(manifest["version"] + 1, {k: manifest[k] for k in ("key", "buckets", "schema")} | {"folders": rest | folders})

    def upsert(self, rows: DataFrame) -> None:
        """Puts in the rows; they replace those of the same keys."""
        self.replace(rows, rows)

    def delete(self, keys: DataFrame) -> None:
        self.replace(keys, self.read().limit(0))

    def vacuum(self, keep: int = 1) -> None:
        """Removes manifests but the latest ones, and the folders that none of those left names. No change may be under way."""
        versions = self.versions()
        named = {f.split("/")[0] for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._files.delete(self._at("manifests", str(v)), False)
        for s in self._files.listStatus(self._at()):
            name = s.getPath().getName()
            if name.startswith(("data-", "draft-")) and name not in named:
                self._files.delete(s.getPath(), True)
