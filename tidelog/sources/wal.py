"""Binary log files: encoding of records as a column, and a checked sequential reader.

A record is a header (magic, version, operation, a zero byte, key size, value size),
key, value and the CRC-32 of all of it, integers little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import ISSUES

# Fixed values of the record form.
MAGIC = b"WAL1"
VERSION = 1
HEADER = struct.Struct("<4sHBBII")
LIMITS = (1024, 1024 * 1024)

RECORDS = "path string, pos long, byte_offset long, op string, key binary, value binary, issue string"


def _little_endian(c: Column, size: int) -> Column:
    """An integer column as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * size - 1 - 2 * k, 2) for k in range(size)]))


def encoded(op: Column, key: Column, value: Column) -> Column:
    """The bytes of one record, built from columns only."""
    key, value = key.cast("binary"), value.cast("binary")
    body = F.concat(
        F.lit(MAGIC),
        _little_endian(F.lit(VERSION), 2),
        _little_endian(F.when(op == "PUT", 1).otherwise(2), 1),
        F.lit(b"\0"),
        _little_endian(F.octet_length(key), 4),
        _little_endian(F.octet_length(value), 4),
        key,
        value,
    )
    return F.concat(body, _little_endian(F.crc32(body), 4))


def scan(data: bytes) -> Iterator[tuple]:
    """(pos, offset, op, key, value, issue) of each record; the first issue ends the scan."""
    at, pos = 0, 0
    while at < len(data):
        pos += 1
        issue = lambda code: (pos, at, None, None, None, code)  # noqa: B023, E731
        if len(data) - at < HEADER.size:
            yield issue(ISSUES[1])
            return
        magic, version, op, zero, n, m = HEADER.unpack_from(data, at)
        for code, bad in zip(ISSUES[2:7], (magic != MAGIC, version != VERSION, op not in (1, 2), zero or not n or n > LIMITS[0] or m > LIMITS[1], op == 2 and m)):
            if bad:
                yield issue(code)
                return
        end = at + HEADER.size + n + m
        if end + 4 > len(data):
            yield issue(ISSUES[1])
            return
        if struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[at:end]):
            yield issue(ISSUES[7])
            return
        key = data[at + HEADER.size : at + HEADER.size + n]
        yield (pos, at, "PUT" if op == 1 else "DELETE", key, data[end - m : end], None)
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of log files, one task for each file (a log is read in order): sound
    records, and a last row with ``issue`` where a file does not end well."""

    def run(batches) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in RECORDS.split(", ")]
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows: list[tuple] = []
                for r in scan(bytes(data)):
                    rows.append((file, *r))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORDS)
