"""Operators on ordered mutation logs: effects, sequences, validity, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import WIDTH, dense_rank_of_rows, position_bucket, previous_in_key, running_total
from ..functions.rules import MAX_KEY_BYTES, MAX_VALUE_BYTES

HEADER_BYTES = 16
# Issue codes; a short header is found first, a short body just before the checksum.
ISSUES = ("IO_ERROR", "INCOMPLETE_RECORD", "INVALID_MAGIC", "UNSUPPORTED_VERSION", "INVALID_OPERATION", "INVALID_LENGTH", "DELETE_WITH_VALUE", "CHECKSUM_MISMATCH")


def with_previous(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``prev``: the key's operation before this one (null: none). A key's history is dealt
    over position buckets, so one key may hold any share of the log."""
    return previous_in_key(log, "op", "prev", width=width)


def takes_effect() -> Column:
    """A PUT always does; a DELETE only on a live key, that is after a PUT."""
    return (F.col("op") == "PUT") | (F.coalesce(F.col("prev"), F.lit("")) == "PUT")


def effective(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """pos, key, op, value, seq: mutations that change something, densely numbered."""
    kept = with_previous(log, width).where(takes_effect()).drop("prev")
    return dense_rank_of_rows(kept, ["pos"], position_bucket("pos"), "seq").select("pos", "key", "op", "value", "seq")


def noop_deletes(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """pos, key of deletes of keys that were not live: they use no sequence number."""
    return with_previous(log, width).where(~takes_effect()).select("pos", "key")


def cluster_deletes(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """pos, key, existed of every delete: a replicated log keeps all of them."""
    return with_previous(log, width).where(F.col("op") == "DELETE").select("pos", "key", (F.coalesce(F.col("prev"), F.lit("")) == "PUT").alias("existed"))


def live_delta() -> Column:
    """+1 where a key comes to life, -1 where it ends, else 0 (needs ``prev``)."""
    prev = F.coalesce(F.col("prev"), F.lit("DELETE"))
    return F.when((F.col("op") == "PUT") & (prev != "PUT"), 1).when((F.col("op") == "DELETE") & (prev == "PUT"), -1).otherwise(0).cast("long")


def live_timeline(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """pos, delta, live: live keys after each logged mutation."""
    return running_total(with_previous(log, width), live_delta(), ["pos"], position_bucket("pos"), "live").select("pos", live_delta().alias("delta"), "live")


def issue_code() -> Column:
    """First issue of a raw record with columns readable, available, needed, magic_ok, version,
    operation, reserved, key_size, value_size, checksum_ok; null if it is sound."""
    c = F.col
    checks = (
        ("IO_ERROR", ~c("readable")),
        ("INCOMPLETE_RECORD", c("available") < HEADER_BYTES),
        ("INVALID_MAGIC", ~c("magic_ok")),
        ("UNSUPPORTED_VERSION", c("version") != 1),
        ("INVALID_OPERATION", ~c("operation").isin(1, 2)),
        ("INVALID_LENGTH", (c("reserved") != 0) | (c("key_size") == 0) | (c("key_size") > MAX_KEY_BYTES) | (c("value_size") > MAX_VALUE_BYTES)),
        ("DELETE_WITH_VALUE", (c("operation") == 2) & (c("value_size") > 0)),
        ("INCOMPLETE_RECORD", c("available") < c("needed")),
        ("CHECKSUM_MISMATCH", ~c("checksum_ok")),
    )
    code = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        code = F.when(bad, F.lit(name)).otherwise(code)
    return code


def first_issue(records: DataFrame) -> DataFrame:
    """One row: position and code of the first record with an issue (nulls: none)."""
    bad = records.withColumn("code", issue_code()).where("code is not null")
    return bad.agg(F.min(F.struct("pos", "code")).alias("f")).select(F.col("f.pos").alias("pos"), F.col("f.code").alias("code"))


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records before the first issue."""
    first = first_issue(records).select(F.col("pos").alias("first_bad"))
    # one row
    return records.join(F.broadcast(first)).where(F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))).drop("first_bad")


def recovery_report(records: DataFrame) -> DataFrame:
    """One row: what a recovery would apply, the valid bytes, whether a tail is cut and why."""
    good = valid_prefix(records).agg(
        F.count(F.lit(1)).alias("records_applied"),
        F.count_if(F.col("operation") == 1).alias("puts_applied"),
        F.count_if(F.col("operation") == 2).alias("deletes_applied"),
        F.coalesce(F.sum("needed"), F.lit(0)).cast("long").alias("valid_bytes"),
    )
    return good.join(F.broadcast(first_issue(records))).select(
        "records_applied", "puts_applied", "deletes_applied", "valid_bytes", F.col("code").isNotNull().alias("tail_truncated"), F.coalesce("code", F.lit("NONE")).alias("issue")
    )


def replayed(records: DataFrame, last_seq: int = 0) -> DataFrame:
    """Recovery: the valid prefix as mutations with new sequence numbers after ``last_seq``."""
    log = valid_prefix(records).select("pos", F.when(F.col("operation") == 1, "PUT").otherwise("DELETE").alias("op"), "key", "value")
    return effective(log).withColumn("seq", F.col("seq") + last_seq)


def checksum(key: str = "key", value: str = "value") -> Column:
    """CRC-32 of operation, lengths, key and value bytes."""
    head = F.concat_ws("|", "op", F.octet_length(key).cast("string"), F.octet_length(value).cast("string"))
    return F.crc32(F.concat(head.cast("binary"), F.col(key).cast("binary"), F.col(value).cast("binary")))


def unflushed(log: DataFrame, flushed: int) -> DataFrame:
    """The log that must be kept: what tables do not hold yet."""
    return log.where(F.col("pos") > flushed)
