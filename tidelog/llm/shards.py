"""Sharded storage with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards of about a ``PIECES``-th of the
arrival's bytes each, from ``TIER_0`` to the target size. Shards of a size tier (powers
of ``FAN_IN``) are merged once there are ``FAN_IN`` of them, into files of about the
target size; a shard of half the target or more is left alone. Every change is a new
manifest, a JSON-lines file that is written aside and renamed to its version number
without replacing: of two writers of one version, one fails and starts again. Readers
take the highest version; replaced shards stay until :meth:`ShardStore.vacuum`, which
spares the versions it is told to keep and files younger than an age, which another
writer may be about to publish. Publishing fails if a file is gone.

Only DataFrame operations touch rows; files are listed, renamed and deleted by the
driver through Hadoop's file system interface.

Defined results: rows are stored as they are (nulls, repeats, extra columns, empty
texts); appending an empty table commits a version without new shards; merging shards
whose columns differ takes the union of columns, missing ones null.

Scale: no shuffle. A merge is one job for a whole tier: the scan packs small shards into
splits and ``coalesce`` joins as many neighbours as make a target-sized file; shards
of one tier are alike in size, so the files are too. The driver handles one manifest
line for each shard (100 TB in 128 MB shards: 800,000 lines), never rows.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET, FAN_IN, TIER_0, PIECES, MIN_AGE_S = 128 << 20, 4, 1 << 20, 4096, 3600.0


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    rows: int
    added: int  # the version that added it
    merged_from: int = 0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN, shard_rows: int | None = None):
        if target < 1 or fan_in < 2 or (shard_rows is not None and shard_rows < 1):
            raise ValueError("target and shard_rows: at least 1, fan_in: at least 2")
        self.spark, self.root, self.target, self.fan_in, self.shard_rows = spark, root.rstrip("/"), target, fan_in, shard_rows
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # files ------------------------------------------------------------
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(folder)
        if not self._fs().exists(p):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(p)]
        return sorted((n, size) for n, size in found if not n.startswith(("_", ".")))

    # manifests ----------------------------------------------------------
    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max((int(n.split(".")[0]) for n, _ in self._list("manifests") if n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs().open(self._path(f"manifests/{version:012d}.json"))
        try:
            lines = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
        return [Shard(**json.loads(x)) for x in lines[1:]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Publishes version ``base + 1``; Conflict if it exists."""
        version, aside = base + 1, self._path(f"manifests/.{uuid.uuid4().hex}")
        body = "\n".join(json.dumps(x, sort_keys=True) for x in [{"version": version, "shards": len(shards)}, *map(asdict, sorted(shards, key=lambda s: s.name))])
        out = self._fs().create(aside, True)
        out.write(bytearray(body.encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(none, 1)
        options[0] = none.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.getFileSystem(self._conf).getUri(), self._conf).rename(aside, self._path(f"manifests/{version:012d}.json"), options)
        except Exception as e:
            self._fs().delete(aside, False)
            raise Conflict(f"version {version} exists: {e}") from e
        return version

    def _publish(self, added: list[tuple[str, int, int]], removed: set[str], merged: int = 0) -> int:
        """Adds and removes shards on top of the latest version, again after a conflict."""
        for batch in {n.rsplit("/", 1)[0] for n, *_ in added}:
            if gone := {n for n, *_ in added if n.startswith(f"{batch}/")} - {f"{batch}/{f}" for f, _ in self._list(batch)}:
                raise Conflict(f"deleted before publishing: {sorted(gone)[:3]}")
        while True:
            base = self.version()
            now = self.shards(base)
            if missing := removed - {s.name for s in now}:
                raise Conflict(f"already replaced: {sorted(missing)[:3]}")
            kept = [s for s in now if s.name not in removed]
            try:
                return self.commit(base, kept + [Shard(n, size, rows, base + 1, merged) for n, size, rows in added])
            except Conflict:
                if self.version() == base:
                    raise

    # rows ---------------------------------------------------------------
    def _write(self, df: DataFrame, rows_per_file: int) -> list[tuple[str, int, int]]:
        batch = f"shards/{uuid.uuid4().hex}"
        where = f"{self.root}/{batch}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(where)
        sizes = self._list(batch)
        if not sizes:
            return []
        counted = self.spark.read.schema(df.schema).parquet(where).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).count()
        n = {r["f"]: r["count"] for r in counted.collect()}  # one row for each file
        return [(f"{batch}/{f}", size, n[f]) for f, size in sizes if n.get(f)]

    def append(self, df: DataFrame) -> int:
        """Stores an arrival as small shards; the new version."""
        return self._publish(self._write(df, self.shard_rows or self._rows_per_shard(df)), set())

    def _rows_per_shard(self, df: DataFrame) -> int:
        """Rows of a shard, from the arrival's bytes before compression."""
        size = lambda f: F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.size(f"`{f.name}`") * 8 if f.dataType.typeName() in ("array", "map") else F.lit(8)
        total = sum((F.coalesce(size(f).cast("long"), F.lit(0)) for f in df.schema.fields), F.lit(0))
        n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
        shard = min(max(TIER_0, total // PIECES), self.target)
        return max(1, int(n * shard // max(1, total)))

    def tier(self, shard: Shard) -> int:
        return max(0, int(math.log(max(1, shard.bytes / TIER_0), self.fan_in)))

    def due(self) -> list[list[Shard]]:
        """Tiers with enough similarly sized runs to merge, smallest tier first."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]

    def compact(self) -> int:
        """Merges tiers until none is due; the latest version."""
        while runs := self.due():
            chosen = runs[0]
            files = max(1, round(sum(s.bytes for s in chosen) / self.target))
            merged = self._write(self._read(chosen).coalesce(files), 0)
            self._publish(merged, {s.name for s in chosen}, len(chosen))
        return self.version()

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("no shards")
        return self._read(shards)

    def vacuum(self, min_age_s: float = MIN_AGE_S, keep: int = 1) -> int:
        """Deletes shard files of at least an age that none of the latest ``keep`` versions names; how many."""
        before = self._jvm.System.currentTimeMillis() - int(min_age_s * 1000)
        found = [f"shards/{batch}/{f}" for batch, _ in self._list("shards") for f, _ in self._list(f"shards/{batch}")]
        last, n = self.version(), 0  # after the listing: what was published since is named
        live = {s.name for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        for name in found:
            if name not in live and self._fs().getFileStatus(self._path(name)).getModificationTime() <= before:
                self._fs().delete(self._path(name), False)
                n += 1
        return n


def shard_documents(docs: DataFrame, root: str) -> DataFrame:
    """Appends, compacts, and gives each stored row's doc_id, shard and text digest as read back."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs)
    version = store.compact()
    store.vacuum(min_age_s=0)  # nobody else writes here
    shards = store.shards(version)
    schema = "doc_id long, shard string, version long, n_chars long, text_sha256 string"
    if not shards:
        return docs.sparkSession.createDataFrame([], schema)
    text = F.coalesce("text", F.lit(""))
    return store.read(version).select(
        F.col("doc_id").cast("long"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"),
        F.lit(version).cast("long").alias("version"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"),
    )
