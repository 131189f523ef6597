"""Limits, codes and predicates on keys, values, commands and batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the data model.
MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 1024 * 1024
MAX_BATCH_ENTRIES = 1024
MAX_BATCH_BYTES = 8 * 1024 * 1024
COMPACTION_TRIGGER = 4
APPEND_ENTRIES = 128
SNAPSHOT_THRESHOLD = 10_000
RING_SLOTS = 10_000
RECORD_OVERHEAD, BLOCK_OVERHEAD = 20, 16


def octets(c: str | Column) -> Column:
    return F.octet_length(F.col(c) if isinstance(c, str) else c)


def key_code(key: str | Column, limit: int = MAX_KEY_BYTES) -> Column:
    """OK, or why a key is refused. A null key is an absent one and counts as empty."""
    n = F.coalesce(octets(key), F.lit(0))
    return F.when(n == 0, "EMPTY_KEY").when(n > limit, "KEY_TOO_LONG").otherwise("OK")


def value_code(value: str | Column, limit: int = MAX_VALUE_BYTES) -> Column:
    """OK, or VALUE_TOO_LONG; empty values are allowed."""
    return F.when(F.coalesce(octets(value), F.lit(0)) > limit, "VALUE_TOO_LONG").otherwise("OK")


def api_error(code: Column) -> Column:
    """The service's error for a validation code: refused arguments, or an internal fault."""
    refused = code.isin("EMPTY_KEY", "KEY_TOO_LONG", "VALUE_TOO_LONG", "BATCH_EMPTY", "BATCH_TOO_MANY", "BATCH_TOO_LARGE")
    return F.when(code == "OK", "OK").when(refused, "INVALID_ARGUMENT").otherwise("INTERNAL")


def command_code(kind: str | Column, key: str | Column, value: str | Column) -> Column:
    """Replicated commands: PUT and DELETE need a valid key, a DELETE no value; NOOP passes."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    key_ok, value_ok = key_code(key) == "OK", value_code(value) == "OK"
    empty = F.coalesce(octets(value), F.lit(0)) == 0
    valid = (kind == "NOOP") | ((kind == "PUT") & key_ok & value_ok) | ((kind == "DELETE") & key_ok & empty)
    return F.when(F.coalesce(valid, F.lit(False)), "OK").otherwise("INVALID_COMMAND")


def quantiles(value: str | Column, by: dict[str, float]) -> list[Column]:
    """Exact quantiles by linear interpolation between order statistics."""
    return [F.percentile(value, q).alias(name) for name, q in by.items()]
