"""The store end to end: writes, restarts, checkpoints, compaction."""

import pytest
from conftest import rows

from tidelog.operators import tables
from tidelog.store import InvalidArgument, KeyValueStore, Options


def kv(spark, *pairs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "ordinal long, key string, value string")


def keys(spark, *names):
    return spark.createDataFrame([(i, k) for i, k in enumerate(names)], "ordinal long, key string")


@pytest.fixture
def store(spark, tmp_path):
    return KeyValueStore(spark, f"{tmp_path}/kv", Options(files=2))


def content(store):
    return {r["key"]: r["value"] for r in store.state().collect()}


def test_put_get_delete(spark, store):
    assert content(store) == {} and store.size() == 0
    store.put(kv(spark, ("first", "one"), ("second", "two"), ("first", "updated")))
    assert content(store) == {"first": "updated", "second": "two"}
    assert store.delete(keys(spark, "second", "missing", "second")) == 1
    assert store.delete(keys(spark, "missing")) == 0
    assert rows(store.get(keys(spark, "first", "second", "third")).select("key", "state", "value")) == [("first", "VALUE", "updated"), ("second", "TOMBSTONE", None), ("third", "MISSING", None)]
    assert rows(store.exists(keys(spark, "first", "second"))) == [("first",)]
    assert store.last_position() == 4


def test_refused_writes_change_nothing(spark, store):
    with pytest.raises(InvalidArgument, match="EMPTY_KEY"):
        store.batch_put(kv(spark, ("valid", "value"), ("", "invalid")))
    small = KeyValueStore(spark, store.root, Options(max_entries=2, max_bytes=8))
    for bad, code in ((kv(spark, ("a", "1"), ("b", "2"), ("c", "3")), "TOO_MANY"), (kv(spark, ("12345", "6789")), "TOO_LARGE"), (kv(spark, ("a", "1")).limit(0), "EMPTY")):
        with pytest.raises(InvalidArgument, match=code):
            small.batch_put(bad)
    assert store.size() == 0 and store.batch_put(kv(spark, ("a", "1"), ("b", "2"), ("c", "3"))) == 3


def test_checkpoint_and_reopen(spark, store):
    store.put(kv(spark, ("key", "persisted"), ("gone", "x")))
    store.checkpoint()
    assert store._batches() == []  # the log is held by tables
    store.put(kv(spark, ("key", "newer")))
    store.delete(keys(spark, "gone"))
    again = KeyValueStore(spark, store.root, store.options)
    assert content(again) == {"key": "newer"} and again.last_position() == 4
    assert again.checkpoint() == 2 and content(again) == {"key": "newer"}
    assert again.checkpoint() == 2  # nothing to flush


def test_compaction_keeps_the_state(spark, store):
    for i, pairs in enumerate(([("a", "old")], [("b", "two")], [("a", "new")], [("c", "three")])):
        store.put(kv(spark, *pairs))
        store.checkpoint()
        assert content(store)[pairs[0][0]] == pairs[0][1], i
    m = store.manifests.load()
    assert [r["level"] for r in m.collect()] == ["L1"] and content(store) == {"a": "new", "b": "two", "c": "three"}
    assert store.vacuum() == 0  # they may be another writer's
    assert store.vacuum(min_age_s=0) == 4 and content(store) == {"a": "new", "b": "two", "c": "three"}
    assert rows(tables.overlapping_neighbours(m)) == []


def test_positions_go_on_after_all_tombstones_are_dropped(spark, store):
    store.put(kv(spark, ("a", "1")))
    store.delete(keys(spark, "a"))
    store.checkpoint()
    store.compact()
    assert store.manifests.load().count() == 0 and store.size() == 0
    store.put(kv(spark, ("a", "2")))
    assert content(store) == {"a": "2"} and store.last_position() == 3


def test_two_ranges_two_level1_tables(spark, store):
    for prefix in "az":
        for i in range(4):
            store.put(kv(spark, (f"{prefix}{i}", "v")))
            store.checkpoint()
    assert [r["level"] for r in store.manifests.load().collect()] == ["L1", "L1"] and store.size() == 8


def test_status(spark, store):
    store.put(kv(spark, ("a", "1"), ("b", "2")))
    store.checkpoint()
    store.delete(keys(spark, "b"))
    r = store.status().first()
    assert (r["live_keys"], r["deleted_keys"], r["level0_tables"], r["unflushed_mutations"], r["last_position"], r["manifest"]) == (1, 1, 1, 1, 3, 1)


def test_nulls_are_refused_not_lost(spark, store):
    for rows_, code in (([(0, "a", "1"), (None, "b", "2")], "NULL_ORDINAL"), ([(0, None, "1")], "EMPTY_KEY"), ([(0, "a", None)], "NULL_VALUE")):
        with pytest.raises(InvalidArgument, match=code):
            store.put(spark.createDataFrame(rows_, "ordinal long, key string, value string"))
    assert store.size() == 0 and store.last_position() == 0


def test_input_is_evaluated_once(spark, store):
    """Rows that differ at each evaluation: what was checked is what is written."""
    from pyspark.sql import functions as F

    rows_ = spark.range(200).select(F.col("id").alias("ordinal"), F.concat(F.lit("k"), F.expr("uuid()")).alias("key"), F.lit("v").alias("value"))
    store.put(rows_)
    assert store.size() == 200 and store.last_position() == 200
    assert store._fs().listStatus(store._path("staging")) is not None and len(list(store._fs().listStatus(store._path("staging")))) == 0


def test_an_older_version_is_a_state_that_existed(spark, store):
    store.put(kv(spark, ("a", "1"), ("b", "1")))
    first = store.checkpoint()
    store.put(kv(spark, ("a", "2"), ("c", "2")))
    second = store.checkpoint()
    store.put(kv(spark, ("d", "3")))
    at = lambda v: {r["key"]: r["value"] for r in store.state(v).collect()}
    assert at(first) == {"a": "1", "b": "1"} and at(second) == {"a": "2", "b": "1", "c": "2"}
    assert content(store) == {"a": "2", "b": "1", "c": "2", "d": "3"}
    with pytest.raises(LookupError):
        store.entries(99)
    store.compact()
    store.vacuum(min_age_s=0)
    with pytest.raises(LookupError, match="vacuumed"):
        store.entries(first)


def test_vacuum_spares_tables_in_flight(spark, store):
    store.put(kv(spark, ("a", "1")))
    store.checkpoint()
    row = store._store(spark.createDataFrame([("z", "9", 9, False)], "key string, value string, seq long, deleted boolean"), 0, 7, 99)
    assert store.vacuum() == 0
    base = store.manifests.latest()
    store._publish(store.manifests.load(base).unionByName(row), base, flushed=9)
    assert content(store) == {"a": "1", "z": "9"}
    gone = store._store(spark.createDataFrame([("y", "8", 10, False)], "key string, value string, seq long, deleted boolean"), 0, 8, 100)
    assert store.vacuum(min_age_s=0) == 1
    with pytest.raises(LookupError, match="gone"):
        store._publish(store.manifests.load().unionByName(gone), base + 1)


def test_concurrent_writers_lose_nothing(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: store.put(kv(spark, *((f"w{w}-{i}", str(i)) for i in range(25)))), range(6)))
    positions = sorted(r["pos"] for r in store.log().select("pos").collect())
    assert positions == list(range(1, 151)) and store.size() == 150 and store._batches() == list(range(1, 7))


def test_batch_numbers_and_file_numbers_go_on(spark, store):
    store.put(kv(spark, ("a", "1")))
    store.checkpoint()
    store.put(kv(spark, ("b", "1")))
    assert store._batches() == [2]
    store.checkpoint()
    files = [r["path"].split("-")[1] for r in store.manifests.load().orderBy("generation").collect()]
    assert files == [f"f{1:020d}", f"f{2:020d}"] and store.manifests.header()["next_file"] == 3


def test_recover_replays_the_valid_prefix(spark, store):
    from conftest import SF

    from tidelog.operators import log
    from tidelog.plans import inputs

    store.put(kv(spark, ("user:1", "before")))
    records = inputs.raw_records(spark, SF)
    report = store.recover(records)
    assert report == log.recovery_report(records).first().asDict() and report["tail_truncated"]
    expect = {"user:1": "before"}
    for r in sorted(log.valid_prefix(records).collect(), key=lambda r: r["pos"]):
        if r["operation"] == 1:
            expect[r["key"]] = r["value"]
        else:
            expect.pop(r["key"], None)
    assert content(store) == expect
