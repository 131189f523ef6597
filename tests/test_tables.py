"""Flushed tables: who wins, what compaction drops, pruning, manifests."""

import pytest
from conftest import rows

from pyspark.sql import functions as F

from tidelog.operators import bloom, tables
from tidelog.sources.manifests import Manifests, StaleManifest

SCHEMA = "generation long, key string, value string, seq long, deleted boolean"


def flushed(spark, *r):
    return spark.createDataFrame([(*x, False) if len(x) == 4 else x for x in r], SCHEMA)


def picked(spark, *generations):
    return spark.createDataFrame([(g,) for g in generations], "generation long")


def test_newest_wins(spark):
    t = flushed(spark, (1, "key", "old", 5), (2, "key", "new", 8))
    assert rows(tables.compact(t, picked(spark, 1, 2)).select("key", "value", "seq")) == [("key", "new", 8)]


def test_four_tables_become_one(spark):
    t = flushed(spark, (1, "a", "old", 1), (2, "b", "two", 2), (3, "a", "new", 3), (4, "c", "three", 4))
    cat = tables.catalogue(t)
    chosen = tables.pick_oldest(cat)
    assert rows(tables.compaction_counters(t, chosen)) == [(4, 1, 4, 3, 0)]
    assert ("a", "new") in rows(tables.compact(t, chosen).select("key", "value"))


def test_tombstone_alone_leaves_no_table(spark):
    t = flushed(spark, (1, "k", "v", 1), (2, "k", "", 2, True))
    assert rows(tables.compaction_counters(t, tables.pick_oldest(tables.catalogue(t), None))) == [(2, 0, 2, 0, 1)]


def test_tombstone_stays_while_an_older_table_holds_the_key(spark):
    t = flushed(spark, (1, "k", "v", 1), (2, "k", "", 2, True), (3, "x", "", 3, True))
    assert rows(tables.droppable(t, picked(spark, 2, 3))) == [("k", 2, False), ("x", 3, True)]
    assert rows(tables.compact(t, picked(spark, 2, 3)).select("key")) == [("k",)]


def test_live_count_does_not_change(spark):
    from tidelog.operators.state import live

    t = flushed(spark, (1, "a", "1", 1), (1, "b", "1", 2), (2, "a", "", 3, True), (3, "c", "1", 4), (3, "b", "2", 5))
    chosen = picked(spark, 1, 2)
    after = t.where("generation = 3").drop("generation").unionByName(tables.compact(t, chosen))
    assert rows(live(t.drop("generation"))) == rows(live(after))


def test_closure_takes_what_it_reaches(spark):
    cat = "generation long, smallest_key string, largest_key string"
    l1 = spark.createDataFrame([(1, "a", "f"), (2, "e", "k"), (3, "m", "p"), (4, "x", "z")], cat)
    seed = spark.createDataFrame([(9, "b", "c")], cat)
    assert [r[0] for r in rows(tables.overlap_closure(seed, l1))] == [1, 2]
    assert rows(tables.overlap_closure(seed.limit(0), l1)) == []
    assert [r[0] for r in rows(tables.overlapping_neighbours(l1))] == [2]


def test_pruning_counts_every_covering_table(spark):
    cat = spark.createDataFrame([(1, "a", "f"), (2, "e", "k"), (3, "m", "p")], "generation long, smallest_key string, largest_key string")
    probes = spark.createDataFrame([("a",), ("e",), ("f",), ("l",), ("zz",)], "key string")
    assert rows(tables.range_prune(cat, probes)) == [("a", 1, 2), ("e", 2, 1), ("f", 2, 1), ("l", 0, 3), ("zz", 0, 3)]


def test_exact_negatives(spark):
    keys = [(0, f"key-{i}", "v", i + 1) for i in range(1000, 2000, 2)]
    t = flushed(spark, *keys)
    probes = spark.createDataFrame([(f"key-{i}",) for i in range(1001, 1201, 2)], "key string")
    assert rows(tables.bloom_checks(tables.catalogue(t), t, probes)) == [(0, 100, 100)]


def test_bloom_sizes(spark):
    cat = spark.createDataFrame([(1, 1), (2, 500), (3, 10_000)], "generation long, entry_count long")
    assert rows(bloom.sizing(cat)) == [(1, 1, 64, 32), (2, 500, 4800, 7), (3, 10_000, 95_872, 7)]
    with pytest.raises(ValueError):
        bloom.sizing(cat, 1.0)


def test_blocks_hold_the_target(spark):
    t = flushed(spark, *[(7, f"key-{i}", f"value-{i}", i + 1) for i in range(1000, 1020)])
    index = tables.block_index(t, 96)
    found = rows(index.orderBy("block"))
    assert len(found) > 1 and sum(r[6] for r in found) == 20
    assert rows(tables.block_gaps(index)) == []
    assert all(r[5] <= 96 for r in found)


def test_sorted_storage_round_trip(spark, tmp_path):
    t = flushed(spark, *[(0, f"key-{i:05d}", "v", i + 1) for i in range(2000)])
    bloom.write_sorted(t, f"{tmp_path}/t", 4)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 2000
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("a").collect()
    assert all(x["z"] < y["a"] for x, y in zip(files, files[1:]))


def test_manifest_versions(spark, tmp_path):
    m = Manifests(spark, f"{tmp_path}/m")
    assert m.latest() == 0 and m.load().count() == 0
    row = spark.createDataFrame([("a.sst", "L0", 1, 2, 1, 2, "a", "b")], "path string, level string, generation long, entry_count long, min_seq long, max_seq long, smallest_key string, largest_key string")
    assert m.commit(row, 0) == 1
    with pytest.raises(StaleManifest):
        m.commit(row, 0)
    assert m.commit(row.limit(0), 1) == 2
    assert rows(m.load(1).select("path", "max_seq")) == [("a.sst", 2)] and m.load().count() == 0
    (tmp_path / "data").mkdir()
    for n in ("a.sst", "orphan.sst", ".hidden"):
        (tmp_path / "data" / n).write_text("x")
    assert rows(tables.orphans(m.listing(f"{tmp_path}/data"), m.load(1))) == [("orphan.sst",)]


def test_rotation_replaces_sizes(spark):
    e = spark.createDataFrame([("a", "x" * 10, 1, False), ("a", "y" * 20, 2, False), ("b", "z" * 50, 3, False), ("c", "", 4, True)], "key string, value string, seq long, deleted boolean")
    found = rows(tables.rotate_by_bytes(e, 70, F.lit(0), overhead=0))
    assert found == [(0, 0, 1, 3, 2, 72), (0, 1, 4, 4, 1, 1)]


def test_files_without_a_manifest_are_adopted(spark, tmp_path):
    t = flushed(spark, (0, "a", "1", 1), (0, "b", "1", 2), (0, "c", "1", 3))
    t.coalesce(1).write.parquet(f"{tmp_path}/t")
    t.where("key = 'c'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    found = tables.catalogue_of_files(stored)
    assert rows(found.select("level", "generation", "entry_count", "smallest_key", "largest_key")) in ([("L0", 1, 1, "c", "c"), ("L0", 2, 3, "a", "c")], [("L0", 1, 3, "a", "c"), ("L0", 2, 1, "c", "c")])
    assert rows(tables.short_files(found, stored)) == []
    more = found.withColumn("entry_count", F.col("entry_count") + F.when(F.col("smallest_key") == "c", 1).otherwise(0))
    assert rows(tables.short_files(more, stored).select("entry_count", "found")) == [(2, 1)]


def test_point_reads_push_the_key_down(spark, tmp_path):
    t = flushed(spark, *[(0, f"key-{i:05d}", "v", i + 1) for i in range(1000)])
    bloom.write_sorted(t, f"{tmp_path}/t", 3)
    plan = spark.read.parquet(f"{tmp_path}/t").where("key = 'key-00042'").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,key-00042)" in plan and "ReadSchema: struct<key:string,value:string>" in plan
