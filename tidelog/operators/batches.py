"""Batch writes: validation before anything is applied, and ordered application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import MAX_BATCH_BYTES, MAX_BATCH_ENTRIES, key_code, octets, value_code


def validated(batches: DataFrame, entries: int = MAX_BATCH_ENTRIES, size: int = MAX_BATCH_BYTES) -> DataFrame:
    """batch_id, entries, bytes, status of rows (batch_id, ordinal, key, value)."""
    bad = (key_code("key") != "OK") | (value_code("value") != "OK")
    summed = batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.coalesce(octets("key"), F.lit(0)) + F.coalesce(octets("value"), F.lit(0))).cast("long").alias("bytes"),
        F.count_if(bad).alias("invalid"),
    )
    status = F.when(F.col("entries") > entries, "BATCH_TOO_MANY").when(F.col("bytes") > size, "BATCH_TOO_LARGE").when(F.col("invalid") > 0, "INVALID_ENTRY").otherwise("OK")
    return summed.select("batch_id", "entries", "bytes", status.alias("status"))


def accepted(batches: DataFrame, entries: int = MAX_BATCH_ENTRIES, size: int = MAX_BATCH_BYTES) -> DataFrame:
    """Rows of the batches that pass whole; nothing of the others."""
    good = validated(batches, entries, size).where("status = 'OK'").select("batch_id")
    return batches.join(good, "batch_id", "left_semi")


def applied_prefix(batches: DataFrame) -> DataFrame:
    """Rows (with ``ok``) of each batch before its first failure: a batch is not atomic."""
    # a range frame: rows that share an ordinal stand or fall together
    window = Window.partitionBy("batch_id").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.max((~F.col("ok")).cast("int")).over(window)
    return batches.withColumn("failed", failed).where("failed = 0").drop("failed")
