"""Stored logs: record form, issues, prefix recovery."""

import zlib

from conftest import rows

from pyspark.sql import functions as F

from tidelog.operators import log, state
from tidelog.sources import logs, wal


def encoded(spark, *ops):
    df = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "i int, op string, key string, value string")
    return [bytes(r[0]) for r in df.orderBy("i").select(wal.encoded(F.col("op"), F.col("key"), F.col("value"))).collect()]


def read(spark, tmp_path, data: bytes):
    (tmp_path / "log.wal").write_bytes(data)
    return [(r["pos"], r["byte_offset"], r["op"], r["key"] and bytes(r["key"]), r["issue"]) for r in wal.read(spark, f"{tmp_path}/log.wal").orderBy("pos").collect()]


def test_checksum_vector(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"123456789"))).first()[0] == 0xCBF43926
    assert zlib.crc32(b"") == 0


def test_round_trip_and_faults(spark, tmp_path):
    a, b = encoded(spark, ("PUT", "first", "one"), ("PUT", "second", "two"))
    assert [r[2:] for r in read(spark, tmp_path, a + b)] == [("PUT", b"first", None), ("PUT", b"second", None)]
    assert read(spark, tmp_path, (a + b)[:-3])[-1] == (2, len(a), None, None, "INCOMPLETE_RECORD")
    flip = bytearray(a + b)
    flip[len(a) + 18] ^= 1
    assert read(spark, tmp_path, bytes(flip))[-1] == (2, len(a), None, None, "CHECKSUM_MISMATCH")
    for at, value, code in ((0, 0, "INVALID_MAGIC"), (4, 9, "UNSUPPORTED_VERSION"), (6, 7, "INVALID_OPERATION"), (7, 1, "INVALID_LENGTH"), (10, 1, "INVALID_LENGTH"), (6, 2, "DELETE_WITH_VALUE")):
        bad = bytearray(a)
        bad[at] = value
        assert read(spark, tmp_path, bytes(bad))[0][4] == code
    assert read(spark, tmp_path, a[:7])[0][4] == "INCOMPLETE_RECORD"


def test_recovery_of_a_sound_log(spark, tmp_path):
    data = b"".join(encoded(spark, ("PUT", "first", "one"), ("PUT", "first", "updated"), ("PUT", "second", "two"), ("DELETE", "second", "")))
    (tmp_path / "l.wal").write_bytes(data)
    m = wal.read(spark, f"{tmp_path}/l.wal").where("issue is null").select("pos", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    assert rows(state.live(state.entries_of(log.effective(m)))) == [("first", "updated", 2)]


def test_thousand_puts(spark, tmp_path):
    data = encoded(spark, *[("PUT", f"key-{i}", f"value-{i}") for i in range(1000)])
    (tmp_path / "l.wal").write_bytes(b"".join(data))
    assert wal.read(spark, f"{tmp_path}/l.wal").where("issue is null").count() == 1000


RAW = "pos long, key string, value string, readable boolean, magic_ok boolean, version int, operation int, reserved int, key_size long, value_size long, checksum_ok boolean, needed long, available long"


def raw(spark, *changes):
    base = dict(key="k", value="v", readable=True, magic_ok=True, version=1, operation=1, reserved=0, key_size=1, value_size=1, checksum_ok=True, needed=22, available=22)
    names = [c.split()[0] for c in RAW.split(", ")]
    made = [{"pos": i + 1, **base, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], RAW)


def test_first_issue_cuts_the_log(spark):
    r = raw(spark, {}, {"operation": 2, "value_size": 0, "value": "", "needed": 21, "available": 21}, {"checksum_ok": False}, {})
    assert rows(log.recovery_report(r)) == [(2, 1, 1, 43, True, "CHECKSUM_MISMATCH")]
    assert rows(log.replayed(r, 10).select("key", "op", "seq")) == [("k", "DELETE", 12), ("k", "PUT", 11)]


def test_sound_and_empty_logs(spark):
    assert rows(log.recovery_report(raw(spark, {}, {}))) == [(2, 2, 0, 44, False, "NONE")]
    assert rows(log.recovery_report(raw(spark, {}).limit(0))) == [(0, 0, 0, 0, False, "NONE")]


def test_order_of_checks(spark):
    r = raw(spark, {"readable": False, "magic_ok": False}, {"available": 3, "magic_ok": False}, {"magic_ok": False, "version": 2}, {"available": 20, "checksum_ok": False})
    assert [x[0] for x in r.select(log.issue_code()).collect()] == ["IO_ERROR", "INCOMPLETE_RECORD", "INVALID_MAGIC", "INCOMPLETE_RECORD"]


def test_stored_log_formats(spark, tmp_path):
    m = spark.createDataFrame([(1, "PUT", "a", "x")], logs.MUTATIONS)
    for fmt in ("parquet", "json"):
        logs.append_log(m, f"{tmp_path}/{fmt}", fmt)
        logs.append_log(m, f"{tmp_path}/{fmt}", fmt)
        assert logs.read_log(spark, f"{tmp_path}/{fmt}", fmt).count() == 2
