"""A replica's storage, and what Bloom filters and table writers promise."""

from pathlib import Path

import pytest
from conftest import rows

from tidelog.operators import bloom, tables
from tidelog.sources.replicas import INITIAL, ReplicaStorage, Replaced

LOG = "index long, term long, type string, key string, value string"


@pytest.fixture
def storage(spark, tmp_path):
    return ReplicaStorage(spark, f"{tmp_path}/replica")


def test_nothing_stored(storage):
    assert rows(storage.hard_state()) == [INITIAL]
    assert storage.log().count() == 0 and storage.snapshot() is None
    with pytest.raises(ValueError):
        ReplicaStorage(storage.spark, "")


def test_hard_state_log_and_snapshot_persist(spark, storage):
    log = [(1, 6, "PUT", "alpha", "one"), (2, 7, "DELETE", "beta", "")]
    storage.save_hard_state(7, "node-2", 2, 2)
    storage.replace_log(spark.createDataFrame(log, LOG))
    storage.save_snapshot(2, 7, spark.createDataFrame([("alpha", "one"), ("none", None)], "key string, value string"))
    again = ReplicaStorage(spark, storage.root + "/")
    assert rows(again.hard_state()) == [(7, "node-2", 2, 2)]
    assert rows(again.log()) == log
    index, term, held = again.snapshot()
    assert (index, term, rows(held.select("key", "value"))) == (2, 7, [("alpha", "one"), ("none", None)])
    again.save_snapshot(9, 8, held.limit(0))  # a state without keys
    assert again.snapshot()[:2] == (9, 8) and again.snapshot()[2].count() == 0
    with pytest.raises(ValueError):
        again.save_snapshot(0, 1, held)


def test_a_log_is_replaced_as_a_whole(spark, storage):
    first = spark.createDataFrame([(1, 1, "PUT", "a", "1"), (2, 1, "PUT", "b", "2")], LOG)
    storage.replace_log(first)
    before = storage.log()
    storage.replace_log(before.where("index > 1"))
    assert [r["index"] for r in storage.log().collect()] == [2] and before.count() == 2
    storage.replace_log(first)
    assert storage.versions("log") == [2, 3] and storage.log().count() == 2


def test_one_of_two_writers_fails(spark, storage, monkeypatch):
    storage.replace_log(spark.createDataFrame([], LOG))
    monkeypatch.setattr(ReplicaStorage, "versions", lambda self, part: [])
    with pytest.raises(Replaced):
        storage.replace_log(spark.createDataFrame([(1, 1, "PUT", "a", "1")], LOG))
    monkeypatch.undo()
    assert storage.log().count() == 0 and [p.name for p in (Path(storage.root) / "log").iterdir() if not p.name.endswith(".crc")] == [f"{1:020d}"]


def test_a_damaged_log_is_not_read(spark, storage):
    storage.replace_log(spark.createDataFrame([(i, 1, "PUT", f"key-{i}", f"value-{i}") for i in range(200)], LOG).coalesce(1))
    (file,) = Path(storage.root).glob("log/*/*.parquet")
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 0x5A
    for crc in file.parent.glob(".*.crc"):  # the file system's own checksum is another's work
        crc.unlink()
    file.write_bytes(data)
    with pytest.raises(Exception):
        storage.log().collect()


def test_filters_never_deny_a_key_they_hold(spark):
    held = spark.range(3000).selectExpr("id % 3 as generation", "concat('key-', id) as key", "id + 1 as seq", "false as deleted", "'v' as value")
    sized = bloom.sizing(tables.catalogue(held), 0.05)
    words = bloom.filters(held, sized)
    assert bloom.may_contain(words, held.select("generation", "key"), sized).where("not may_contain").count() == 0
    absent = spark.range(6000).selectExpr("id % 3 as generation", "concat('absent-', id) as key")
    answers = bloom.may_contain(words, absent, sized)
    counted = rows(bloom.false_positives(answers, held).select("generation", "checks", "negatives", "false_positives"))
    assert [r[:2] for r in counted] == [(g, 2000) for g in range(3)]
    assert all(n + f == 2000 and 0 < f < 2 * 0.05 * 2000 for _, _, n, f in counted)
    assert answers.count() == 6000 and bloom.may_contain(words.limit(0), absent.limit(5), sized).where("may_contain").count() == 0


def test_tables_refuse_what_breaks_their_rules(spark, tmp_path):
    schema = "key string, value string, seq long, deleted boolean"
    good = [("a", "1", 1, False), ("b", None, 2, True)]
    for bad, code in (([], "EMPTY"), ([*good, ("a", "2", 3, False)], "DUPLICATE"), ([("a", "1", 0, False)], "BAD_SEQUENCE"), ([("a", "1", None, False)], "BAD_SEQUENCE"), ([(None, "1", 1, False)], "NO_KEY")):
        with pytest.raises(ValueError, match=code):
            bloom.write_checked(spark.createDataFrame(bad, schema), f"{tmp_path}/t")
    assert not (tmp_path / "t").exists()
    bloom.write_checked(spark.createDataFrame(good, schema), f"{tmp_path}/t")
    assert rows(spark.read.schema(schema).parquet(f"{tmp_path}/t")) == good
