"""Versions, tiers, conflicts, and rows read back."""

import hashlib

import pytest
from conftest import SF
from llm.odd import documents, empty

from tidelog.llm import shards
from tidelog.llm.queries import op8_size_tiered_sharding


def test_query_returns_every_row(spark):
    found = sorted((r["doc_id"], r["n_chars"], r["text_sha256"]) for r in op8_size_tiered_sharding(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted((r["doc_id"], len(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs)


def test_similar_runs_merge_to_target_sized_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = shards.ShardStore(spark, f"{tmp_path}/s", target=150_000, shard_rows=8)
    assert store.version() == 0 and store.shards() == []
    first = store.append(docs)
    small = store.shards(first)
    assert first == 1 and len(small) >= 20 and sum(s.rows for s in small) == 200
    last = store.compact()
    merged = store.shards(last)
    assert last > first and not store.due()
    assert len(merged) < len(small) and sum(s.rows for s in merged) == 200
    assert max(s.bytes for s in merged) < 3 * 150_000
    assert sorted(map(str, store.read(last).collect())) == sorted(map(str, docs.collect()))
    assert store.read(first).count() == 200  # the old version reads until it is vacuumed
    assert store.vacuum() == 0 and store.vacuum(0, keep=last) == 0 and store.read(first).count() == 200
    assert store.vacuum(0) > 0 and store.read().count() == 200


def test_shards_grow_with_the_arrival_up_to_the_target(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(shards, "TIER_0", 20_000)
    store = shards.ShardStore(spark, f"{tmp_path}/s")
    assert 200 * 20_000 / total * 0.5 < store._rows_per_shard(docs) <= 200 * 20_000 / total
    monkeypatch.setattr(shards, "PIECES", 4)  # larger than the least: a fourth of the arrival each
    assert store._rows_per_shard(docs) == 50
    assert shards.ShardStore(spark, f"{tmp_path}/t", target=1)._rows_per_shard(docs) == 1
    assert store._rows_per_shard(docs.limit(0)) >= 1


def test_vacuum_spares_what_is_about_to_be_published(spark, tmp_path):
    docs = documents(spark)
    store = shards.ShardStore(spark, f"{tmp_path}/s", shard_rows=5)
    store.append(docs)
    written = store._write(docs, 5)
    assert store.vacuum() == 0
    store._publish(written, set())
    assert store.read().count() == 2 * docs.count()
    written = store._write(docs, 5)
    assert store.vacuum(0) == len(written)
    with pytest.raises(shards.Conflict):
        store._publish(written, set())
    assert store.read().count() == 2 * docs.count()


def test_arrivals_add_up(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = shards.ShardStore(spark, f"{tmp_path}/s", shard_rows=50)
    for _ in range(3):
        store.append(docs.coalesce(1))
        store.compact()
    assert store.read().count() == 600
    assert all(len(t) < store.fan_in for t in [[s for s in store.shards() if store.tier(s) == k] for k in range(9)])


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    store = shards.ShardStore(spark, f"{tmp_path}/s")
    store.append(documents(spark))
    with pytest.raises(shards.Conflict):
        store.commit(0, [])
    assert store.version() == 1 and not [n for n in (tmp_path / "s" / "manifests").iterdir() if n.name.startswith(".") and not n.name.endswith(".crc")]
    gone = {store.shards()[0].name}
    store._publish([], gone)
    with pytest.raises(shards.Conflict):
        store._publish([], gone)


def test_odd_documents(spark, tmp_path):
    docs = documents(spark)
    store = shards.ShardStore(spark, f"{tmp_path}/s", shard_rows=2)
    store.append(docs)
    store.append(docs.select("doc_id", "text"))  # fewer columns
    store.append(empty(spark))
    store.compact()
    assert store.read().count() == 2 * docs.count() and store.read().where("key is null").count() >= docs.count()
    assert shards.shard_documents(docs, f"{tmp_path}/t").count() == docs.count()
    assert shards.shard_documents(empty(spark), f"{tmp_path}/u").count() == 0
    with pytest.raises(ValueError):
        shards.ShardStore(spark, f"{tmp_path}/v", fan_in=1)
