"""Versioned tables: immutable Parquet snapshots and a manifest whose creation is the compare-and-swap.

A commit writes a snapshot under a name of its own and then creates the manifest ``<version>.json``, which must not exist. Manifests carry the
highest epoch; a commit under a lower one is refused before anything is written.

A :class:`BucketedTable` keeps its rows in hash buckets of a key, each a part of its own: a commit rewrites the buckets that it touches and names the others again.
"""

from __future__ import annotations

import json
import uuid

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.errors import StaleEpochError, VersionConflictError
from factloom.sources.workspace import Files, local


class VersionedTable:
    def __init__(self, spark: SparkSession, base: str, schema: str):
        self.spark, self.schema = spark, schema
        self.files = Files(spark, base)

    def _manifests(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.files.names("log") if x.endswith(".json"))

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        found = self._manifests()
        return found[-1] if found else 0

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        text = self.files.read(f"log/{v:012d}.json") if v else None
        return json.loads(text) if text else {"version": 0, "epoch": 0, "parts": []}

    def max_epoch(self) -> int:
        return self.manifest()["epoch"]

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.manifest(version)["parts"]
        if not parts:
            return local(self.spark, [], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.files.path(p) for p in parts])

    def guard(self, epoch: int) -> dict:
        now = self.manifest()
        if epoch < now["epoch"]:
            raise StaleEpochError(f"epoch {epoch} is below {now['epoch']}")
        return now

    def commit(self, df: DataFrame | None, epoch: int, expected: int | None = None, append: bool = False, note: dict | None = None) -> int:
        """Publishes ``df`` as the next version (or adds it to the current one); None publishes the epoch alone."""
        now = self.guard(epoch)
        if expected is not None and now["version"] != expected:
            raise VersionConflictError(f"version {now['version']} is not {expected}")
        parts = list(now["parts"]) if append or df is None else []
        if df is not None:
            name = f"data/{uuid.uuid4().hex}"
            df.write.parquet(self.files.path(name))
            parts.append(name)
        version = now["version"] + 1
        text = json.dumps({"version": version, "epoch": max(epoch, now["epoch"]), "parts": parts, **(note or {})})
        if not self.files.create(f"log/{version:012d}.json", text):
            raise VersionConflictError(f"version {version} was published by somebody else")
        return version

    def expire(self, keep: int = 2) -> None:
        """Deletes snapshots that only manifests older than the last ``keep`` name, and those manifests."""
        versions = self._manifests()
        old, new = versions[:-keep], versions[-keep:]
        used = {p for v in new for p in self.manifest(v)["parts"]}
        for v in old:
            for p in self.manifest(v)["parts"]:
                if p not in used:
                    self.files.delete(p)
            self.files.delete(f"log/{v:012d}.json")


class BucketedTable(VersionedTable):
    """State by key. The number of buckets is a property of the table: it is kept in the manifest and outlives the setting that made it."""

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, buckets: int = 32):
        super().__init__(spark, base, schema)
        self.key, self._wanted = key, buckets

    def buckets(self) -> int:
        return self.manifest().get("buckets", self._wanted)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets())).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(self.key))).distinct().collect())

    def read_buckets(self, only: Iterable[int]) -> DataFrame:
        parts, wanted = self.manifest()["parts"], set(only)
        own = [p for p in parts if int(p.rpartition("=")[2]) in wanted]
        return self.spark.read.schema(self.schema).parquet(*[self.files.path(p) for p in own]) if own else local(self.spark, [], self.schema)

    def change(self, rows: DataFrame, epoch: int, merge: Callable[[DataFrame], DataFrame], expected: int | None = None, note: dict | None = None) -> int:
        """Replaces the touched buckets' rows by ``merge`` of them; ``rows`` only say which buckets are touched. All other parts stay as they are."""
        now = self.guard(epoch)
        if expected is not None and now["version"] != expected:
            raise VersionConflictError(f"version {now['version']} is not {expected}")
        hit = self.touched(rows)
        if hit:
            folder = f"data/{uuid.uuid4().hex}"
            merged = merge(self.read_buckets(hit)).withColumn("_bucket", self.bucket(F.col(self.key)))
            merged.repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(self.files.path(folder))
            written = [f"{folder}/{x}" for x in self.files.names(folder) if x.startswith("_bucket=")]
        else:
            written = []
        parts = [p for p in now["parts"] if int(p.rpartition("=")[2]) not in hit] + written
        version = now["version"] + 1
        text = json.dumps({"version": version, "epoch": max(epoch, now["epoch"]), "parts": parts, "buckets": now.get("buckets", self._wanted), **(note or {})})
        if not self.files.create(f"log/{version:012d}.json", text):
            raise VersionConflictError(f"version {version} was published by somebody else")
        return version

    def commit(self, df: DataFrame | None, epoch: int, expected: int | None = None, append: bool = False, note: dict | None = None) -> int:
        """Publishes ``df`` as the whole table; None publishes the epoch alone. Rows are added by :meth:`change`."""
        if append:
            raise ValueError("a bucketed table is changed, not appended to")
        if df is None:
            return super().commit(None, epoch, expected, note={"buckets": self.buckets(), **(note or {})})
        now = self.guard(epoch)
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self.bucket(F.col(self.key))).repartition(self.buckets(), "_bucket").write.partitionBy("_bucket").parquet(self.files.path(folder))
        parts = [f"{folder}/{x}" for x in self.files.names(folder) if x.startswith("_bucket=")]
        version = now["version"] + 1
        if expected is not None and now["version"] != expected:
            raise VersionConflictError(f"version {now['version']} is not {expected}")
        text = json.dumps({"version": version, "epoch": max(epoch, now["epoch"]), "parts": parts, "buckets": self.buckets(), **(note or {})})
        if not self.files.create(f"log/{version:012d}.json", text):
            raise VersionConflictError(f"version {version} was published by somebody else")
        return version
