"""Mutation logs as streams: micro-batch flushes, and keyed latest-value state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest
from ..sources.logs import MUTATIONS


def trigger_for(mode: str, interval_ms: int = 100) -> dict:
    """Trigger of a durability mode: SYNC commits each batch as it comes, BATCH at an interval,
    NONE drains what is there and stops."""
    return {"SYNC": {"processingTime": "0 seconds"}, "BATCH": {"processingTime": f"{interval_ms} milliseconds"}, "NONE": {"availableNow": True}}[mode]


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stored log as an unbounded source."""
    reader = spark.readStream.schema(MUTATIONS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def flush_batches(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Writes one reduced table for each micro-batch: its newest version of each key, in a
    folder of its own, so a batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        entries = batch.select("key", "value", F.col("pos").alias("seq"), (F.col("op") == "DELETE").alias("deleted"))
        latest(entries).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flushed(spark: SparkSession, out: str) -> DataFrame:
    """key, value, seq, deleted of all flushed batches."""
    return spark.read.parquet(out).select("key", "value", "seq", "deleted")


def _newest() -> Callable:
    def run(key, batches, state):
        import pandas as pd

        seq, value, deleted = state.get if state.exists else (0, "", True)
        for pdf in batches:
            i = pdf["pos"].idxmax()
            if pdf.at[i, "pos"] > seq:  # rows that come again change nothing
                seq, value, deleted = int(pdf.at[i, "pos"]), pdf.at[i, "value"], pdf.at[i, "op"] == "DELETE"
        state.update((seq, value, bool(deleted)))
        yield pd.DataFrame([(key[0], value, seq, bool(deleted))], columns=["key", "value", "seq", "deleted"])

    return run


def latest_by_key(stream: DataFrame) -> DataFrame:
    """Updates (key, value, seq, deleted) of keyed state: the newest mutation wins, in any order of arrival."""
    return stream.groupBy("key").applyInPandasWithState(
        _newest(), "key string, value string, seq long, deleted boolean", "seq long, value string, deleted boolean", "update", "NoTimeout"
    )
