"""A key-value store of batches: log, flushed tables, manifests, compaction, recovery.

The five calls of the service (put, delete, batch put, get, status) and the maintenance
calls (checkpoint, compact, recover, vacuum) at the grain of DataFrames. Below a root folder:

- ``log/batch=<n>``: mutations, in order of position; a batch is one committed write;
- ``tables/<name>``: flushed and compacted tables, range-partitioned and sorted by key;
- ``manifests``: a version for each change of the table set; its header carries the log
  position up to which the tables hold everything, and the next file number.

Writers are serialised by the batch numbers and the manifest versions: both are written
aside and renamed without replacing, so a number exists once and never half. A writer
that comes second numbers its rows anew. Input is evaluated once, into a staged table
that is checked and then written. Reads resolve one manifest version, the tables it names
and the log after them; an older version is read as of its own flushed position.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.order import dense_rank_of_rows, position_bucket
from .functions.rules import COMPACTION_TRIGGER, MAX_BATCH_BYTES, MAX_BATCH_ENTRIES, key_code, octets, value_code
from .operators import bloom, log, state, tables
from .sources.logs import MUTATIONS
from .sources.manifests import TABLES, Manifests, renamed

ENTRIES = "key string, value string, seq long, deleted boolean"


class InvalidArgument(ValueError):
    """A key, value or batch beyond the limits; nothing of it was applied."""


@dataclass(frozen=True)
class Options:
    trigger: int = COMPACTION_TRIGGER
    files: int | None = None  # of a table; None: as many as the shuffle makes
    max_entries: int = MAX_BATCH_ENTRIES
    max_bytes: int = MAX_BATCH_BYTES
    tries: int = 20  # of a write that other writers overtake
    vacuum_age_s: float = 3600.0  # younger tables may be another writer's, not published yet
    keep_versions: int = 1  # manifests whose tables vacuum spares


class KeyValueStore:
    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):
        if options.trigger < 1:
            raise ValueError("trigger: at least 1")
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.manifests = Manifests(spark, f"{self.root}/manifests")

    # log ----------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        p, fs = self._path("log"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch="))

    def log(self, after: int = 0) -> DataFrame:
        """Logged mutations after a position."""
        found = self._batches()
        if not found:
            return self.spark.createDataFrame([], MUTATIONS)
        paths = [f"{self.root}/log/batch={n}" for n in found]
        return self.spark.read.schema(MUTATIONS).parquet(*paths).where(F.col("pos") > after)

    def last_position(self) -> int:
        logged = self.log().agg(F.max("pos").alias("p")).first()["p"] if self._batches() else 0
        return max(logged or 0, self._flushed())

    def _append(self, rows: DataFrame) -> None:
        """rows: ordinal, op, key, value, in order of ordinal, from a staged table."""
        for _ in range(self.options.tries):
            number = max([0, *self._batches(), *self._dropped()]) + 1
            numbered = dense_rank_of_rows(rows, ["ordinal"], position_bucket("ordinal"), "pos", self.last_position() + 1).select("pos", "op", "key", "value")
            aside = f"staging/{uuid.uuid4().hex}"
            numbered.write.parquet(f"{self.root}/{aside}")
            self._fs().mkdirs(self._path("log"))
            try:
                renamed(self.spark, self._path(aside), self._path(f"log/batch={number}"))
                return
            except Exception:
                self._fs().delete(self._path(aside), True)
                if number not in self._batches() and number not in self._dropped():
                    raise
        raise RuntimeError("append: other writers were first each time")

    def _dropped(self) -> list[int]:
        """The highest batch number whose log was dropped, so that no number comes twice."""
        p = self._path("dropped")
        return [int(s.getPath().getName()) for s in self._fs().listStatus(p)] if self._fs().exists(p) else []

    @contextmanager
    def _staged(self, rows: DataFrame):
        """The rows as a table: a write evaluates its input once."""
        aside = f"staging/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.root}/{aside}")
            yield self.spark.read.schema(rows.schema).parquet(f"{self.root}/{aside}")
        finally:
            self._fs().delete(self._path(aside), True)

    @staticmethod
    def _refuse(rows: DataFrame) -> None:
        order = F.when(F.col("ordinal").isNull(), "NULL_ORDINAL") if "ordinal" in rows.columns else F.lit(None)
        absent = F.when(F.col("value").isNull(), "NULL_VALUE")
        bad = rows.select(F.coalesce(order, F.when(key_code("key") != "OK", key_code("key")), absent, value_code("value")).alias("code")).where("code <> 'OK'").limit(1).collect()
        if bad:
            raise InvalidArgument(bad[0]["code"])

    # writes ---------------------------------------------------------------
    def put(self, rows: DataFrame) -> None:
        """Writes rows (ordinal, key, value) in order; a null in any of them is refused."""
        with self._staged(rows.select("ordinal", "key", "value")) as staged:
            self._put(staged)

    def _put(self, staged: DataFrame) -> None:
        self._refuse(staged)
        self._append(staged.select("ordinal", F.lit("PUT").alias("op"), "key", "value"))

    def batch_put(self, rows: DataFrame) -> int:
        """As put, for a client's batch: refused whole beyond the limits. How many were applied."""
        with self._staged(rows.select("ordinal", "key", "value")) as staged:
            r = staged.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(octets("key") + octets("value")), F.lit(0)).alias("b")).first()
            if not 0 < r["n"] <= self.options.max_entries or r["b"] > self.options.max_bytes:
                raise InvalidArgument("BATCH_EMPTY" if not r["n"] else "BATCH_TOO_MANY" if r["n"] > self.options.max_entries else "BATCH_TOO_LARGE")
            self._put(staged)
        return r["n"]

    def delete(self, keys: DataFrame) -> int:
        """Deletes keys (ordinal, key); those that are not live leave nothing in the log. How many were."""
        with self._staged(keys.select("ordinal", "key")) as staged:
            self._refuse(staged.withColumn("value", F.lit("")))
            first = staged.groupBy("key").agg(F.min("ordinal").alias("ordinal"))
            with self._staged(first.join(self.state().select("key"), "key", "left_semi")) as live:
                n = live.count()
                if n:
                    self._append(live.select("ordinal", F.lit("DELETE").alias("op"), "key", F.lit("").alias("value")))
        return n

    def recover(self, records: DataFrame) -> dict:
        """Replays raw log records (as ``operators.log.valid_prefix`` takes them): what takes
        effect before the first issue is appended in order. The report of the recovery."""
        report = log.recovery_report(records).first().asDict()
        found = log.valid_prefix(records).select(F.col("pos").alias("ordinal"), F.when(F.col("operation") == 1, "PUT").otherwise("DELETE").alias("op"), "key", "value")
        with self._staged(found) as staged:
            # a DELETE counts after a PUT of these records, or of a key that is live already
            was = self.state().select("key", F.lit("PUT").alias("stored"))
            prev = log.with_previous(staged.withColumnRenamed("ordinal", "pos")).join(was, "key", "left").withColumn("prev", F.coalesce("prev", "stored"))
            with self._staged(prev.where(log.takes_effect()).select(F.col("pos").alias("ordinal"), "op", "key", "value")) as kept:
                if not kept.isEmpty():
                    self._append(kept)
        return report

    # reads ----------------------------------------------------------------
    def _tables(self, names: DataFrame) -> DataFrame:
        """generation, key, value, seq, deleted of the named tables (a manifest's rows)."""
        paths = [f"{self.root}/tables/{r['path']}" for r in names.select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], f"generation long, {ENTRIES}")
        # one scan for all tables; a table's name holds its generation
        generation = F.regexp_extract(F.input_file_name(), r"/L\d-f\d{20}-g(\d{20})-", 1).cast("long")
        return self.spark.read.schema(ENTRIES).parquet(*paths).select(generation.alias("generation"), "key", "value", "seq", "deleted")

    def entries(self, version: int | None = None) -> DataFrame:
        """All stored versions that count: the tables of the latest manifest and the log after
        them; for an older manifest, its tables: the state at the position it was flushed at."""
        if version is not None:
            if version not in self.manifests.versions():
                raise LookupError(f"no manifest {version}")
            gone = [r["path"] for r in self.manifests.load(version).select("path").collect() if not self._fs().exists(self._path(f"tables/{r['path']}"))]
            if gone:
                raise LookupError(f"manifest {version}: {len(gone)} tables were vacuumed")
            return self._tables(self.manifests.load(version)).drop("generation")
        version = self.manifests.latest()
        memory = self.log(self._flushed(version)).select("key", "value", F.col("pos").alias("seq"), (F.col("op") == "DELETE").alias("deleted"))
        return self._tables(self.manifests.load(version)).drop("generation").unionByName(memory)

    def state(self, version: int | None = None) -> DataFrame:
        """key, value, seq of all live keys, now or at a manifest version."""
        return state.live(self.entries(version))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, state (VALUE, TOMBSTONE, MISSING), value, seq of some keys."""
        self._refuse(keys.withColumn("value", F.lit("")))
        return state.multi_get(self.entries(), keys.select("key").distinct())

    def exists(self, keys: DataFrame) -> DataFrame:
        return state.exists(self.entries(), keys.select("key").distinct())

    def size(self) -> int:
        return self.state().count()

    # maintenance ------------------------------------------------------------
    def _flushed(self, version: int | None = None) -> int:
        """Log position up to which the tables of a version hold everything."""
        return self.manifests.header(version)["flushed"]

    def _store(self, table: DataFrame, level: int, generation: int, file: int) -> DataFrame | None:
        """Writes a table; its manifest row, or None if it has no rows."""
        name = f"L{level}-f{file:020d}-g{generation:020d}-{uuid.uuid4().hex[:12]}"
        bloom.write_sorted(table.select("key", "value", "seq", "deleted"), f"{self.root}/tables/{name}", self.options.files)
        back = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/tables/{name}")
        r = back.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z"), F.min("key").alias("low"), F.max("key").alias("high")).first()
        row = (name, f"L{level}", int(generation), r["n"], r["a"], r["z"], r["low"], r["high"])
        return self.spark.createDataFrame([row], TABLES) if r["n"] else None

    def checkpoint(self) -> int:
        """Flushes the log after the tables into a level-0 table, compacts while that is due,
        and drops the log that tables hold. The manifest version."""
        base = self.manifests.latest()
        current, position = self.manifests.load(base), self.last_position()
        memory = self.log(self._flushed(base)).where(F.col("pos") <= position).select("key", "value", F.col("pos").alias("seq"), (F.col("op") == "DELETE").alias("deleted"))
        generation = (current.agg(F.max("generation").alias("g")).first()["g"] or 0) + 1
        file = self.manifests.header(base)["next_file"]
        row = self._store(state.latest(memory), 0, generation, file)
        if row is not None:
            base = self._publish(current.unionByName(row), base, flushed=position, next_file=file + 1)
        while self.manifests.load(base).where("level = 'L0'").count() >= self.options.trigger:
            base = self.compact(force=False)
        self._reset_log(position)
        return base

    def _publish(self, rows: DataFrame, base: int, **header) -> int:
        """Commits a table set whose files are all there."""
        for r in rows.select("path").collect():
            if not self._fs().exists(self._path(f"tables/{r['path']}")):
                raise LookupError(f"{r['path']}: the table is gone")
        return self.manifests.commit(rows, base, **header)

    def _reset_log(self, position: int) -> None:
        """Drops the batches whose positions all lie in tables."""
        for n in self._batches():
            path = f"{self.root}/log/batch={n}"
            last = self.spark.read.schema(MUTATIONS).parquet(path).agg(F.max("pos").alias("p")).first()["p"]
            if last is None or last <= position:
                self._fs().mkdirs(self._path(f"dropped/{n}"))
                self._fs().delete(self._path(f"log/batch={n}"), True)
        for n in sorted(self._dropped())[:-1]:  # the highest is enough
            self._fs().delete(self._path(f"dropped/{n}"), True)

    def compact(self, force: bool = True) -> int:
        """Merges the oldest level-0 tables (all of them if forced) and the level-1 tables that
        they reach into one level-1 table. The manifest version."""
        base = self.manifests.latest()
        current = self.manifests.load(base)
        level0 = tables.pick_oldest(current.where("level = 'L0'"), None if force else self.options.trigger)
        if not level0.count():
            return base
        level1 = tables.overlap_closure(level0, current.where("level = 'L1'"))
        chosen = level0.unionByName(level1)
        everything = self._tables(current)
        generation = chosen.agg(F.max("generation").alias("g")).first()["g"]
        file = self.manifests.header(base)["next_file"]
        row = self._store(tables.compact(everything, chosen), 1, generation, file)
        kept = current.join(chosen.select("path"), "path", "left_anti").select(*current.columns)
        return self._publish(kept if row is None else kept.unionByName(row), base, next_file=file + 1)

    def vacuum(self, min_age_s: float | None = None) -> int:
        """Deletes table folders that none of the manifests kept names and that are old enough
        not to be another writer's, still to be published; how many."""
        age = self.options.vacuum_age_s if min_age_s is None else min_age_s
        listed = self.manifests.listing(f"{self.root}/tables", age)
        for v in self.manifests.versions()[-max(1, self.options.keep_versions) :]:
            listed = tables.orphans(listed, self.manifests.load(v))
        gone = listed.collect()
        for r in gone:
            self._fs().delete(self._path(f"tables/{r['path']}"), True)
        return len(gone)

    def status(self) -> DataFrame:
        """One row about the store."""
        m = self.manifests.load().agg(
            F.count_if(F.col("level") == "L0").alias("level0_tables"),
            F.count_if(F.col("level") == "L1").alias("level1_tables"),
            F.coalesce(F.sum("entry_count"), F.lit(0)).alias("stored_entries"),
        )
        live = state.live_count(self.entries()).select("live_keys", "deleted_keys")
        memory = self.log(self._flushed(self.manifests.latest())).agg(F.count(F.lit(1)).alias("unflushed_mutations"))
        return live.join(F.broadcast(m)).join(F.broadcast(memory)).withColumn("last_position", F.lit(max(self.last_position(), self._flushed())).cast("long")).withColumn("manifest", F.lit(self.manifests.latest()).cast("long"))
