"""Point operations on versions: who wins, what a tombstone hides, what takes effect."""

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidelog.functions import rules
from tidelog.operators import log, state
from tidelog.plans import inputs
from tidelog.sources import logs

LOG = "pos long, op string, key string, value string"
ENTRIES = "key string, value string, seq long, deleted boolean"


def mutations(spark, *ops):
    return spark.createDataFrame([(i + 1, *o) for i, o in enumerate(ops)], LOG)


def put(k, v="v"):
    return ("PUT", k, v)


def delete(k):
    return ("DELETE", k, "")


def entries(spark, *ops):
    return state.entries_of(log.effective(mutations(spark, *ops)))


def test_update_takes_a_new_sequence(spark):
    e = entries(spark, put("first", "one"), put("second", "two"), put("first", "updated"))
    assert rows(state.latest(e)) == [("first", "updated", 3, False), ("second", "two", 2, False)]


def test_delete_leaves_a_tombstone(spark):
    e = entries(spark, put("key"), delete("key"))
    assert rows(state.tombstones(e)) == [("key", 2)]
    assert rows(state.live(e)) == []


def test_delete_of_a_missing_key_uses_no_sequence(spark):
    m = mutations(spark, delete("missing"), put("a"))
    assert rows(log.effective(m).select("key", "seq")) == [("a", 1)]
    assert rows(log.noop_deletes(m)) == [(1, "missing")]
    assert rows(log.cluster_deletes(m)) == [(1, "missing", False)]


def test_key_comes_back(spark):
    e = entries(spark, put("k", "one"), delete("k"), put("k", "two"))
    assert rows(state.live(e)) == [("k", "two", 3)]
    assert rows(state.history(e)) == [("k", 1, 2, False), ("k", 2, 3, True), ("k", 3, None, False)]
    assert rows(state.as_of(e, 2)) == [] and rows(state.as_of(e, 1)) == [("k", "one", 1)]


def test_half_updated_half_removed(spark):
    keys = [f"key-{i:03d}" for i in range(400)]
    ops = [put(k) for k in keys] + [put(k, "new") if i % 2 == 0 else delete(k) for i, k in enumerate(keys)]
    e = entries(spark, *ops)
    assert rows(state.live_count(e)) == [(200, 200, 400)]


def test_lookup_is_three_valued(spark):
    e = entries(spark, put("a", ""), put("b"), delete("b"))
    probes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert rows(state.multi_get(e, probes)) == [("a", "VALUE", "", 1), ("b", "TOMBSTONE", None, 3), ("c", "MISSING", None, None)]
    assert rows(state.exists(e, probes)) == [("a",)]
    assert rows(state.get(e, "a")) == [("a", True, "")]
    assert rows(state.get(e, "b")) == [("b", False, None)]


def test_memory_hides_tables(spark):
    stored = spark.createDataFrame([("a", "old", 1, False), ("b", "kept", 2, False), ("c", "gone", 3, False)], ENTRIES)
    memory = spark.createDataFrame([("a", "new", 4, False), ("c", "", 5, True)], ENTRIES)
    assert rows(state.overlay(memory, stored)) == [("a", "new", 4, "memory"), ("b", "kept", 2, "table")]


def test_put_and_remove_in_memory(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    r = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    assert rows(state.put(s, r)) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert rows(state.removed(s, r.select("key"))) == [("a", "1")]


def test_versions_must_ascend(spark):
    e = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 0)], "pos long, key string, seq long")
    assert rows(state.out_of_order(e)) == [(2, "a", 1), (4, "b", 0)]


def test_limits(spark):
    df = spark.createDataFrame([(b"",), (b"k" * 1024,), (b"k" * 1025,), (None,)], "b binary")
    assert [r[0] for r in df.select(rules.key_code("b")).collect()] == ["EMPTY_KEY", "OK", "KEY_TOO_LONG", "EMPTY_KEY"]
    df = spark.createDataFrame([(b"",), (b"v" * (1 << 20),), (b"v" * ((1 << 20) + 1),), (b"a\0b",)], "b binary")
    assert [r[0] for r in df.select(rules.value_code("b")).collect()] == ["OK", "OK", "VALUE_TOO_LONG", "OK"]


def test_commands(spark):
    c = spark.createDataFrame([("NOOP", "", ""), ("PUT", "a", ""), ("PUT", "", "v"), ("DELETE", "a", ""), ("DELETE", "a", "v"), ("OTHER", "a", "")], "t string, k string, v string")
    assert [r[0] == "OK" for r in c.select(rules.command_code("t", "k", "v")).collect()] == [True, True, False, True, False, False]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 4)), max_size=40))
def test_effects_match_a_replay(spark, ops):
    held, seq, expect, timeline = set(), 0, [], []
    for i, (is_put, k) in enumerate(ops):
        if is_put or k in held:
            seq += 1
            expect.append((i + 1, seq))
        (held.add if is_put else held.discard)(k)
        timeline.append(len(held))
    m = mutations(spark, *[("PUT" if p else "DELETE", f"k{k}", "") for p, k in ops]) if ops else spark.createDataFrame([], LOG)
    assert rows(log.effective(m).select("pos", "seq")) == expect or sorted(expect) == [tuple(r) for r in log.effective(m).select("pos", "seq").orderBy("pos").collect()]
    assert [r["live"] for r in log.live_timeline(m).orderBy("pos").collect()] == timeline


def test_key_filters_reach_the_scan(spark, tmp_path):
    """A key predicate moves below the aggregate; a predicate on ``deleted`` must not."""
    spark.createDataFrame([("a", "1", 1, False), ("a", "", 2, True)], ENTRIES).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    plan = state.live(e).where("key = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan and "deleted" not in plan.split("PushedFilters")[1].split("]")[0]
    assert rows(state.live(e)) == []


def test_sequences_need_no_single_partition_of_rows(spark, tmp_path):
    e = log.effective(logs.events_log(spark, "/root/testdata/sf0.001"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the prefix sum over one row for each bucket
    assert "CartesianProduct" not in plan


def test_synthetic_workload(spark):
    w = logs.synthetic(spark, 10, 500, 0.8)
    assert w.count() == 500 and 300 < w.where("op = 'GET'").count() < 480
    assert w.where("op = 'PUT' and length(value) <> 256").count() == 0


def test_base_relations(spark):
    assert inputs.entries(spark, "/root/testdata/sf0.001").count() > 0


def test_a_hot_key_may_be_dealt_over_buckets(spark):
    m = logs.events_log(spark, "/root/testdata/sf0.001")
    m = m.withColumn("key", F.when(F.col("pos") % 3 > 0, "hot").otherwise(F.col("key")))
    for width in (1, 7, 64, 1 << 20):
        assert rows(log.effective(m, width)) == rows(log.effective(m))
