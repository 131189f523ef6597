"""Relations that the catalogue's queries share, derived from the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log, state, tables
from ..sources.logs import events_log, table

#: Sequence numbers in a generation, and the newest generations, which level 1 does not hold yet.
CHECKPOINT, NEW = 500, 4


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one in local mode without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidelog-")
    return named.rstrip("/")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.entries_of(log.effective(events_log(spark, sf_dir)))


def level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flushed tables: generation, key, value, seq, deleted."""
    return tables.flush(tables.generations(entries(spark, sf_dir), CHECKPOINT))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.catalogue(level0(spark, sf_dir))


def stored_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flushed tables as files, which queries that mention them several times read."""
    path = f"{scratch(spark)}/level0-{uuid.uuid4().hex[:12]}"
    level0(spark, sf_dir).write.parquet(path)
    return spark.read.schema("generation long, key string, value string, seq long, deleted boolean").parquet(path)


def level1(l0: DataFrame) -> DataFrame:
    """Level 1 as five key ranges (by the first digit after the prefix) of what all but the
    newest generations left alive."""
    last = F.broadcast(l0.agg(F.max("generation").alias("last")))
    old = state.latest(l0.join(last).where(F.col("generation") <= F.col("last") - NEW).drop("last")).where(~F.col("deleted"))
    digit = F.substring("key", 6, 1).cast("long")
    return old.select(F.floor(digit / 2).cast("long").alias("generation"), "key", "value", "seq", "deleted")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: those of all customers' numbers, most of which no event wrote."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log records with faults planted at fixed distances."""
    e = table(spark, sf_dir, "events")
    i, deleted = F.col("event_id"), F.col("event_type") == "error"
    at = lambda n: i % n == n - 1
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    value = F.when(deleted, "").otherwise(F.coalesce("props", F.lit("")))
    sized = e.select(
        (i + 1).alias("pos"),
        i.alias("i"),
        key.alias("key"),
        value.alias("value"),
        (~at(9973)).alias("readable"),
        (~at(1213)).alias("magic_ok"),
        F.when(at(1301), 2).otherwise(1).alias("version"),
        F.when(at(1409), 7).when(deleted, 2).otherwise(1).alias("operation"),
        F.when(at(1511), 1).otherwise(0).alias("reserved"),
        F.when(at(1607), 0).otherwise(F.octet_length(key)).cast("long").alias("key_size"),
        F.when(deleted & (i % 331 == 7), 5).otherwise(F.octet_length(value)).cast("long").alias("value_size"),
        (~at(1709)).alias("checksum_ok"),
    )
    needed = (16 + F.col("key_size") + F.col("value_size") + 4).cast("long")
    available = F.when(F.col("i") % 877 == 876, 10).when(F.col("i") % 1009 == 1008, needed - 3).otherwise(needed)
    return sized.withColumn("needed", needed).withColumn("available", available.cast("long")).drop("i")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of order lines: some keys are empty."""
    key = F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))
    value = F.concat_ws("|", F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("ordinal"), key.alias("key"), value.alias("value"))


def leader_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, index, term, type, key, value: every thousandth entry opens a term with a no-op."""
    n = F.col("pos")
    return events_log(spark, sf_dir).select(
        F.lit("node-1").alias("node"),
        n.alias("index"),
        (1 + F.floor((n - 1) / 1000)).cast("long").alias("term"),
        F.when((n - 1) % 1000 == 0, "NOOP").otherwise(F.col("op")).alias("type"),
        "key",
        "value",
    )


def log_length(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").count()


def follower_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follower with nine tenths of the entries, of other terms in its last third."""
    n = log_length(spark, sf_dir)
    mine = leader_log(spark, sf_dir).where(F.col("index") <= n * 9 // 10)
    other = F.col("index") > n * 6 // 10
    return mine.select(F.lit("node-2").alias("node"), "index", F.when(other, F.col("term") + 1).otherwise(F.col("term")).alias("term"), "type", "key", F.when(other, F.concat(F.lit("lost:"), F.col("value"))).otherwise(F.col("value")).alias("value"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica positions: an order is a cell, its lines are nodes."""
    m = (F.col("l_partkey") % 100 + 1).alias("match_index")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cell"), m, F.floor((F.col("l_partkey") % 100 + 1) / 25).cast("long").alias("entry_term"), (F.col("l_orderkey") % 4).alias("current_term"), (F.col("l_orderkey") % 30).alias("committed")
    )


def vote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    node = lambda n: F.concat(F.lit("node-"), n.cast("string"))
    return table(spark, sf_dir, "orders").select(
        o.alias("voter"),
        (c % 5 + 1).alias("term"),
        node(o % 3).alias("candidate"),
        (c % 4).alias("last_term"),
        (o % 100).alias("last_index"),
        (o % 5 + 1).alias("own_term"),
        F.when(o % 4 > 0, node(o % 4 - 1)).alias("voted_for"),
        (o % 4).alias("own_last_term"),
        (c % 100).alias("own_last_index"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, name, value observations."""
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), F.col("event_type").alias("name"), "value")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op, ok, latency of a workload."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.when(kind.isin("view", "click"), "GET").otherwise("PUT").alias("op"), (kind != "error").alias("ok"), F.col("value").alias("latency"))
