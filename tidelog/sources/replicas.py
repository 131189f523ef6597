"""A replica's own storage: hard state, log and snapshot, each replaced as a whole.

A part is a folder of numbered versions; a version is written aside as Parquet and renamed
to its number without replacing, so that a reader sees the one before or the one after,
and of two writers of one number one fails. Page checksums are verified on reading.
The log and the snapshot are relations of any size; the hard state is one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import renamed

HARD_STATE = "current_term long, voted_for string, commit_index long, last_applied long"
REPLICA_LOG = "index long, term long, type string, key string, value string"
SNAPSHOT = "last_included_index long, last_included_term long, key string, value string"
#: The hard state of a replica that has stored none.
INITIAL = (0, None, 0, 0)


class Replaced(RuntimeError):
    """Another writer stored this version first."""


class ReplicaStorage:
    def __init__(self, spark: SparkSession, root: str):
        if not root:
            raise ValueError("root: a folder")
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self, part: str) -> list[int]:
        p = self._path(part)
        names = [s.getPath().getName() for s in self._fs().listStatus(p)] if self._fs().exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _replace(self, part: str, rows: DataFrame, schema: str) -> int:
        names = [c.split()[0] for c in schema.split(", ")]
        version = max(self.versions(part), default=0) + 1
        aside = f"{part}/.{uuid.uuid4().hex}"
        rows.select(*[F.col(n).cast(c.split()[1]) for n, c in zip(names, schema.split(", "))]).write.parquet(f"{self.root}/{aside}")
        try:
            renamed(self.spark, self._path(aside), self._path(f"{part}/{version:020d}"))
        except Exception as e:
            self._fs().delete(self._path(aside), True)
            raise Replaced(f"{part}: version {version} exists") from e
        for old in self.versions(part):
            if old < version - 1:  # the one before may still be read
                self._fs().delete(self._path(f"{part}/{old:020d}"), True)
        return version

    def _load(self, part: str, schema: str) -> DataFrame | None:
        found = self.versions(part)
        if not found:
            return None
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(f"{self.root}/{part}/{found[-1]:020d}")

    def save_hard_state(self, current_term: int, voted_for: str | None, commit_index: int, last_applied: int) -> int:
        row = self.spark.createDataFrame([(current_term, voted_for, commit_index, last_applied)], HARD_STATE)
        return self._replace("hard-state", row.coalesce(1), HARD_STATE)

    def hard_state(self) -> DataFrame:
        """One row; the initial state if none is stored."""
        found = self._load("hard-state", HARD_STATE)
        return self.spark.createDataFrame([INITIAL], HARD_STATE) if found is None else found

    def replace_log(self, log: DataFrame) -> int:
        """Stores the whole log in place of the one before."""
        return self._replace("log", log, REPLICA_LOG)

    def log(self) -> DataFrame:
        found = self._load("log", REPLICA_LOG)
        return self.spark.createDataFrame([], REPLICA_LOG) if found is None else found

    def save_snapshot(self, index: int, term: int, rows: DataFrame) -> int:
        """Stores key, value rows as the state at an index above 0. A row without a key stands
        for the snapshot itself, which may hold no keys."""
        if index < 1:
            raise ValueError("index: above 0")
        header = self.spark.createDataFrame([(None, None)], "key string, value string")
        at = (F.lit(index).alias("last_included_index"), F.lit(term).alias("last_included_term"))
        return self._replace("snapshot", rows.where("key is not null").select("key", "value").unionByName(header).select(*at, "key", "value"), SNAPSHOT)

    def snapshot(self) -> tuple[int, int, DataFrame] | None:
        """Index, term and rows of the stored snapshot, if there is one."""
        found = self._load("snapshot", SNAPSHOT)
        if found is None:
            return None
        head = found.where("key is null").first()
        return head["last_included_index"], head["last_included_term"], found.where("key is not null")
