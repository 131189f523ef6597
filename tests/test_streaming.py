"""Streams drain to the batch result."""

from conftest import SF, rows

from tidelog.operators import state
from tidelog.sources.logs import events_log
from tidelog.streaming import state as streaming


def test_flushed_batches_and_a_rerun(spark, tmp_path):
    events_log(spark, SF).repartition(3).write.parquet(f"{tmp_path}/log")
    for _ in range(2):  # the second run finds nothing new
        q = streaming.flush_batches(streaming.read_stream(spark, f"{tmp_path}/log", 1), f"{tmp_path}/tables", f"{tmp_path}/c")
        q.awaitTermination()
    log = events_log(spark, SF).selectExpr("key", "value", "pos as seq", "op = 'DELETE' as deleted")
    assert rows(state.live(streaming.flushed(spark, f"{tmp_path}/tables"))) == rows(state.live(log))


def test_keyed_state(spark, tmp_path):
    events_log(spark, SF).repartition(2).write.parquet(f"{tmp_path}/log")
    updates = streaming.latest_by_key(streaming.read_stream(spark, f"{tmp_path}/log", 1))
    q = updates.writeStream.outputMode("update").format("memory").queryName("keyed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    log = events_log(spark, SF).selectExpr("key", "value", "pos as seq", "op = 'DELETE' as deleted")
    assert rows(state.live(spark.table("keyed"))) == rows(state.live(log))


def test_durability_modes():
    assert streaming.trigger_for("NONE") == {"availableNow": True} and streaming.trigger_for("BATCH", 250) == {"processingTime": "250 milliseconds"}
