"""Latest-value state: point and batch reads, membership, history, merged reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import WIDTH, next_in_key, previous_in_key


def latest(entries: DataFrame, by: list | None = None) -> DataFrame:
    """The newest version of each key, tombstones too (columns key, value, seq, deleted kept).

    An aggregate: map tasks combine, so a key with very many versions costs no more."""
    others = [c for c in entries.columns if c != "key"]
    order = F.struct(*(by or [F.col("seq")]))
    return entries.groupBy("key").agg(F.max_by(F.struct(*others), order).alias("e")).select("key", "e.*")


def entries_of(effective: DataFrame) -> DataFrame:
    """key, value, seq, deleted from effective mutations."""
    return effective.select("key", "value", "seq", (F.col("op") == "DELETE").alias("deleted"))


def live(entries: DataFrame) -> DataFrame:
    """key, value, seq of live keys. The filter stands above the aggregate: below it, it
    would bring deleted versions back."""
    return latest(entries).where(~F.col("deleted")).select("key", "value", "seq")


def tombstones(entries: DataFrame) -> DataFrame:
    return latest(entries).where("deleted").select("key", "seq")


def live_count(entries: DataFrame) -> DataFrame:
    """One row: live keys, deleted keys, keys."""
    return latest(entries).agg(
        F.count_if(~F.col("deleted")).alias("live_keys"),
        F.count_if("deleted").alias("deleted_keys"),
        F.count(F.lit(1)).alias("all_keys"),
    )


def get(entries: DataFrame, key: str) -> DataFrame:
    """One row: key, found, value. Catalyst moves the key below the aggregate to the scan."""
    hit = live(entries).where(F.col("key") == key)
    probe = entries.sparkSession.createDataFrame([(key,)], "key string")
    return probe.join(hit, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "value")


def multi_get(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probed key: VALUE, TOMBSTONE or MISSING, with value and seq."""
    state = F.when(F.col("seq").isNull(), "MISSING").when(F.col("deleted"), "TOMBSTONE").otherwise("VALUE")
    return probes.join(latest(entries), "key", "left").select("key", state.alias("state"), F.when(~F.col("deleted"), F.col("value")).alias("value"), "seq")


def exists(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """The probed keys that are live."""
    return probes.join(live(entries), "key", "left_semi")


def removed(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without some keys, which leave no trace (in-memory removal)."""
    return state.join(keys, "key", "left_anti")


def put(state: DataFrame, rows: DataFrame) -> DataFrame:
    """State (key, value) with rows inserted or replaced."""
    return state.join(rows, "key", "left_anti").unionByName(rows)


def history(entries: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, seq, valid_to, deleted: each version until the next one shadows it."""
    return next_in_key(entries.select("key", "seq", "deleted"), "seq", "valid_to", pos="seq", width=width).select("key", "seq", "valid_to", "deleted")


def as_of(entries: DataFrame, seq: int) -> DataFrame:
    """The live state just after a sequence number."""
    return live(entries.where(F.col("seq") <= seq))


def out_of_order(entries: DataFrame, width: int = WIDTH) -> DataFrame:
    """Versions whose seq is not above the key's previous one in log order, or not positive."""
    return previous_in_key(entries, "seq", "before", width=width).where((F.col("seq") <= F.coalesce(F.col("before"), F.lit(0)))).select("pos", "key", "seq")


def overlay(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Memory over storage: key, value, seq, source of live keys; a tombstone in memory hides."""
    both = latest(memory).withColumn("rank", F.lit(1)).withColumn("source", F.lit("memory")).unionByName(
        latest(stored).withColumn("rank", F.lit(0)).withColumn("source", F.lit("table")).select("key", *[c for c in memory.columns if c != "key"], "rank", "source")
    )
    return latest(both, [F.col("rank")]).where(~F.col("deleted")).select("key", "value", "seq", "source")
