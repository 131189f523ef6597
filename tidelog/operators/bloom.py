"""Bloom filter sizing, and storage whose scans use min-max statistics and Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, WORD_BITS, MAX_HASHES = 64, 64, 32


def raw_bits(n: Column, p: float) -> Column:
    """ceil(-n ln p / (ln 2)^2), at least 64: before rounding to words."""
    return F.greatest(F.ceil(-n * math.log(p) / math.log(2) ** 2).cast("long"), F.lit(MIN_BITS).cast("long"))


def sizing(catalog: DataFrame, p: float = 0.01) -> DataFrame:
    """generation, entry_count, bits, hashes: words of 64 bits; hashes come from the unrounded size."""
    if not 0 < p < 1:
        raise ValueError("p: between 0 and 1")
    n = F.greatest(F.col("entry_count"), F.lit(1))
    m = raw_bits(n, p)
    bits = (F.ceil(m / WORD_BITS) * WORD_BITS).cast("long")
    hashes = F.least(F.greatest(F.floor(m / n * math.log(2) + 0.5), F.lit(1)), F.lit(MAX_HASHES)).cast("long")
    return catalog.select("generation", "entry_count", bits.alias("bits"), hashes.alias("hashes"))


def totals(sized: DataFrame, checks: DataFrame) -> DataFrame:
    """One row over all tables: filters, keys, bytes, checks, negatives."""
    joined = sized.join(checks, "generation", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("filters"),
        F.sum("entry_count").alias("keys"),
        F.sum(F.col("bits") / 8).cast("long").alias("bytes"),
        F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
    )


def positions(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """generation, key, word, mask: the bits that a table's filter has for a key, by words of
    64 (a mask for each). Bit i is (h1 + i * h2) modulo the size, h1 and h2 two 52-bit parts of MD5."""
    part = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 13), 16, 10).cast("long")
    hashed = rows.where("key is not null").select("generation", "key", part(1).alias("h1"), part(14).alias("h2")).join(sized.select("generation", "bits", "hashes"), "generation")
    bit = hashed.select("generation", "key", F.explode(F.expr("transform(sequence(0L, hashes - 1), i -> (h1 + i * h2) % bits)")).alias("bit"))
    return bit.groupBy("generation", "key", F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))


def filters(entries: DataFrame, sized: DataFrame) -> DataFrame:
    """generation, word, mask: the words of each table's filter that have a bit set."""
    return positions(entries, sized).groupBy("generation", "word").agg(F.expr("bit_or(mask)").alias("mask"))


def may_contain(words: DataFrame, asked: DataFrame, sized: DataFrame) -> DataFrame:
    """generation, key, may_contain for each different pair that is asked: false is certain.
    Keys meet words of their own table only, spread over (generation, word)."""
    needed = positions(asked.select("generation", "key").distinct(), sized)
    has = F.coalesce(F.col("mask").bitwiseAND(F.col("held")) == F.col("mask"), F.lit(False))
    held = needed.join(words.withColumnRenamed("mask", "held"), ["generation", "word"], "left")
    return held.groupBy("generation", "key").agg(F.bool_and(has).alias("may_contain"))


def false_positives(answers: DataFrame, entries: DataFrame) -> DataFrame:
    """generation, checks, negatives, false_positives of answers from :func:`may_contain`."""
    there = entries.select("generation", "key").distinct().withColumn("there", F.lit(True))
    return answers.join(there, ["generation", "key"], "left").groupBy("generation").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("may_contain")).alias("negatives"),
        F.count_if(F.col("may_contain") & F.col("there").isNull()).alias("false_positives"),
    )


def refused(table: DataFrame) -> DataFrame:
    """key, fault of what a table may not hold: NO_KEY, BAD_SEQUENCE (null or below 1), DUPLICATE
    (of a key, once); one EMPTY row without a key if the table has no rows."""
    by = table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("seq", F.lit(0))).alias("least"))
    fault = F.when(F.col("key").isNull(), "NO_KEY").when(F.col("least") < 1, "BAD_SEQUENCE").when(F.col("n") > 1, "DUPLICATE")
    empty = table.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("key"), F.lit("EMPTY").alias("fault"))
    return by.select("key", fault.alias("fault")).where("fault is not null").unionByName(empty)


def write_checked(table: DataFrame, path: str, files: int | None = None) -> None:
    """:func:`write_sorted` of key, value, seq, deleted rows, refused if any breaks a table's rules."""
    if bad := refused(table).first():
        raise ValueError(f"{bad['fault']}: {bad['key']!r}")
    write_sorted(table, path, files)


def write_sorted(table: DataFrame, path: str, files: int | None = None, block_bytes: int = 32 << 20) -> None:
    """Range-partitioned, sorted Parquet with a Bloom filter on the key: point reads skip
    files and row groups by statistics, and most of the rest by the filter."""
    dealt = table.repartitionByRange(files, "key") if files else table.repartitionByRange("key")
    (
        dealt.sortWithinPartitions("key")
        .write.mode("errorifexists")
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.block.size", block_bytes)
        .parquet(path)
    )


def cache_hit_ratio(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses), 0 without lookups."""
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))
