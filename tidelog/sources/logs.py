"""Mutation logs from the driver's tables, and readers of stored logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import dense_rank_of_rows

MUTATIONS = "pos long, op string, key string, value string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, op, key, value: each event writes its user's key; errors delete it."""
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("pos"),
        F.when(deleted, "DELETE").otherwise("PUT").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(deleted, "").otherwise(F.col("props")).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, op, key, value: orders by date and key write their customer; finished ones delete it."""
    deleted = F.col("o_orderstatus") == "F"
    orders = table(spark, sf_dir, "orders")
    ranked = dense_rank_of_rows(orders, ["o_orderdate", "o_orderkey"], F.col("o_orderdate").cast("date"), "pos")
    return ranked.select(
        "pos",
        F.when(deleted, "DELETE").otherwise("PUT").alias("op"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"),
        F.when(deleted, "").otherwise(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")).alias("value"),
    )


def read_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored log of the MUTATIONS schema."""
    return spark.read.schema(MUTATIONS).format(fmt).load(path)


def append_log(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    log.write.mode("append").format(fmt).save(path)


def synthetic(spark: SparkSession, keys: int, operations: int, read_ratio: float = 0.8, value_bytes: int = 256, seed: int = 1) -> DataFrame:
    """Uniform keys and a Bernoulli choice of reads: worker-free form of a closed-loop workload."""
    drawn = spark.range(operations).select(
        (F.col("id") + 1).alias("pos"),
        F.when(F.rand(seed) < read_ratio, "GET").otherwise("PUT").alias("op"),
        F.concat(F.lit("key-"), F.lpad(F.floor(F.rand(seed + 1) * keys).cast("string"), 8, "0")).alias("key"),
    )
    return drawn.withColumn("value", F.when(F.col("op") == "PUT", F.rpad(F.concat(F.lit("value-"), F.col("pos").cast("string")), value_bytes, "x")).otherwise(""))
