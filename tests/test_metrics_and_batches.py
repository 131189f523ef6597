"""Metrics, reports and batch writes."""

import json

from conftest import rows

from pyspark.sql import functions as F

from tidelog.operators import batches, bloom, metrics

SAMPLES = "pos long, name string, value double"


def test_counter_gauge_histogram_text(spark):
    c = spark.createDataFrame([(1, "c", 1.0), (2, "c", 2.0)], SAMPLES)
    g = spark.createDataFrame([(1, "g", 3.0), (2, "g", 7.0)], SAMPLES)
    h = spark.createDataFrame([(1, "h", 0.001), (2, "h", 0.010)], SAMPLES)
    assert rows(metrics.counters(c)) == [("c", 3.0)] and rows(metrics.gauges(g)) == [("g", 7.0)]
    text = [r["line"] for r in metrics.prometheus(metrics.counters(c), metrics.gauges(g), metrics.histograms(h)).orderBy("section", "name", "line_no").collect()]
    assert text[:4] == ["c 3.000000", "g 7.000000", "h_count 2", "h_sum 0.011000"] and text[-1] == 'h{quantile="0.99"} 0.009910'


def test_ring_replaces_slots(spark):
    s = spark.createDataFrame([(i, "x", float(i)) for i in range(1, 9)], SAMPLES)
    slots = {}
    for i in range(1, 9):
        slots[i - 1 if i <= 5 else i % 5] = float(i)
    kept = sorted(slots.values())
    r = metrics.ring(s, 5).first()
    assert (r["count"], r["sum"]) == (8, 36.0) and r["p50"] == kept[2]


def test_report_of_nothing(spark):
    r = metrics.workload_report(spark.createDataFrame([], "op string, ok boolean, latency double"), 1).first()
    assert r["operations"] == 0 and r["error_rate"] == 0.0 and r["max"] is None


def test_json_lines_escape(spark):
    e = spark.createDataFrame([("2026-01-02 03:04:05", "start", 'a\n"b"\\')], "t string, event string, message string").withColumn("ts", F.to_timestamp("t"))
    line = metrics.json_lines(e, ["message"]).first()["line"]
    assert "\\n" in line and '\\"b\\"' in line and json.loads(line)["timestamp"] == "2026-01-02T03:04:05Z"


def test_hit_ratio(spark):
    df = spark.createDataFrame([(3, 1), (0, 0)], "h long, m long")
    assert [r[0] for r in df.select(bloom.cache_hit_ratio(F.col("h"), F.col("m"))).collect()] == [0.75, 0.0]


B = "batch_id long, ordinal int, key string, value string"


def test_a_batch_is_refused_whole(spark):
    b = spark.createDataFrame([(1, 0, "valid", "value"), (1, 1, "", "invalid"), (2, 0, "a", "1"), (2, 1, "b", "2"), (2, 2, "c", "3")], B)
    assert rows(batches.validated(b).select("batch_id", "status")) == [(1, "INVALID_ENTRY"), (2, "OK")]
    assert rows(batches.accepted(b).select("key")) == [("a",), ("b",), ("c",)]


def test_batch_limits(spark):
    b = spark.createDataFrame([(1, 0, "a", "1"), (1, 1, "b", "2"), (1, 2, "c", "3"), (2, 0, "12345", "6789")], B)
    assert rows(batches.validated(b, 2, 8).select("batch_id", "status")) == [(1, "BATCH_TOO_MANY"), (2, "BATCH_TOO_LARGE")]


def test_application_stops_at_the_first_failure(spark):
    b = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)], "batch_id long, ordinal int, ok boolean")
    assert rows(batches.applied_prefix(b).select("batch_id", "ordinal")) == [(1, 0), (2, 0)]
