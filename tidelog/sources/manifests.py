"""Versioned table sets: a manifest for each version, published by one atomic rename.

The first line of a manifest is a header (log position up to which the tables hold
everything, next file number); each further line is a table. A rename without
replacement is atomic on HDFS; object stores need a committer that offers the same.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "path string, level string, generation long, entry_count long, min_seq long, max_seq long, smallest_key string, largest_key string"
HEADER = ("flushed", "next_file")


class StaleManifest(RuntimeError):
    """The version to build on is no longer the latest."""


def renamed(spark: SparkSession, source, target) -> None:
    """Renames a path without replacing; raises if the target exists."""
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    conf = spark._jsc.hadoopConfiguration()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf).rename(source, target, options)


class Manifests:
    """Manifests below a folder. Rows are one for each file, so the driver can hold them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        p = self._path("")
        fs = p.getFileSystem(self._conf)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def load(self, version: int | None = None) -> DataFrame:
        """The tables of a version (default: the latest); empty before the first."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], TABLES)
        return self.spark.read.schema(TABLES).json(f"{self.root}/manifest-{version:020d}.json").where("path is not null")

    def header(self, version: int | None = None) -> dict[str, int]:
        """flushed and next_file of a version; 0 and 1 before the first."""
        version = self.latest() if version is None else version
        if not version:
            return {"flushed": 0, "next_file": 1}
        schema = ", ".join(f"{n} long" for n in HEADER)
        r = self.spark.read.schema(schema).json(f"{self.root}/manifest-{version:020d}.json").where("flushed is not null").first()
        return {n: r[n] for n in HEADER} if r else {"flushed": self.load(version).agg({"max_seq": "max"}).first()[0] or 0, "next_file": 1}

    def commit(self, tables: DataFrame, base: int, flushed: int | None = None, next_file: int | None = None) -> int:
        """Publishes the next version; StaleManifest if another writer was first. What the
        header is not given it takes from the version it builds on."""
        names = [c.split()[0] for c in TABLES.split(", ")]
        header = self.header(base) | {k: v for k, v in (("flushed", flushed), ("next_file", next_file)) if v is not None}
        lines = [header, *({n: r[n] for n in names} for r in tables.select(*names).collect())]
        aside, final = self._path(f".{uuid.uuid4().hex}"), self._path(f"manifest-{base + 1:020d}.json")
        fs = aside.getFileSystem(self._conf)
        out = fs.create(aside, True)
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines).encode()))
        out.close()
        try:
            renamed(self.spark, aside, final)
        except Exception as e:
            fs.delete(aside, False)
            raise StaleManifest(f"version {base + 1} exists") from e
        return base + 1

    def listing(self, folder: str, min_age_s: float = 0) -> DataFrame:
        """path of every data file in a folder that is at least so old, for orphan checks and adoption."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self._conf)
        before = self.spark._jvm.System.currentTimeMillis() - int(min_age_s * 1000)
        found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return self.spark.createDataFrame([(n,) for n, t in sorted(found) if not n.startswith(("_", ".")) and (not min_age_s or t < before)], "path string")
