"""The catalogue of queries: one for each operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import batches, bloom, log, metrics, replication, state, tables
from ..sources.logs import events_log, orders_log, table
from ..sources.replicas import ReplicaStorage
from ..sources.wal import encoded
from ..streaming import state as streaming
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# state ------------------------------------------------------------------------
@query
def latest_state(spark, d):
    return state.live(inputs.entries(spark, d))


@query
def point_get(spark, d):
    return state.get(inputs.entries(spark, d), "user:7")


@query
def multi_get(spark, d):
    return state.multi_get(inputs.entries(spark, d), inputs.probes(spark, d))


@query
def exists_keys(spark, d):
    return state.exists(inputs.entries(spark, d), inputs.probes(spark, d))


@query
def tombstones(spark, d):
    return state.tombstones(inputs.entries(spark, d))


@query
def live_count(spark, d):
    return state.live_count(inputs.entries(spark, d))


@query
def version_history(spark, d):
    return state.history(inputs.entries(spark, d))


@query
def state_as_of(spark, d):
    return state.as_of(inputs.entries(spark, d), 700)


@query
def key_ordered_snapshot(spark, d):
    return state.latest(inputs.entries(spark, d)).orderBy("key")


@query
def orders_state(spark, d):
    return state.live(state.entries_of(log.effective(orders_log(spark, d))))


@query
def memory_put_remove(spark, d):
    """In-memory store: probes put over the state, then even customers removed."""
    now = state.live(inputs.entries(spark, d)).select("key", "value")
    put = state.put(now, inputs.probes(spark, d).withColumn("value", F.lit("put")))
    even = table(spark, d, "customer").where(F.col("c_custkey") % 2 == 0)
    return state.removed(put, even.select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key")))


# log --------------------------------------------------------------------------
@query
def effective_mutations(spark, d):
    return log.effective(events_log(spark, d))


@query
def sequence_assign(spark, d):
    return log.effective(events_log(spark, d)).select("pos", "seq")


@query
def noop_deletes(spark, d):
    return log.noop_deletes(events_log(spark, d))


@query
def cluster_deletes(spark, d):
    return log.cluster_deletes(events_log(spark, d))


@query
def live_timeline(spark, d):
    return log.live_timeline(events_log(spark, d))


@query
def sequence_violations(spark, d):
    """Versions written in log order with the event's user as sequence: not all ascend."""
    e = table(spark, d, "events").select((F.col("event_id") + 1).alias("pos"), F.col("event_type").alias("key"), F.col("user_id").alias("seq"))
    return state.out_of_order(e)


@query
def wal_issue_classify(spark, d):
    return inputs.raw_records(spark, d).select("pos", F.coalesce(log.issue_code(), F.lit("NONE")).alias("code"))


@query
def wal_valid_prefix(spark, d):
    return log.valid_prefix(inputs.raw_records(spark, d)).select("pos", "key", "operation", "needed")


@query
def recovery_report(spark, d):
    return log.recovery_report(inputs.raw_records(spark, d))


@query
def recovery_replay(spark, d):
    return log.replayed(inputs.raw_records(spark, d), 1000)


@query
def log_checksums(spark, d):
    return events_log(spark, d).select("pos", log.checksum().alias("crc32"))


@query
def wal_encode(spark, d):
    data = encoded(F.col("op"), F.col("key"), F.col("value"))
    return events_log(spark, d).select("pos", F.octet_length(data).cast("long").alias("bytes"), F.lower(F.hex(F.substring(data, 1, 16))).alias("header"))


# validation -------------------------------------------------------------------
@query
def validate_keys_values(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.key_code("text").alias("key_code"), rules.value_code("text", 4096).alias("value_code"), rules.api_error(rules.key_code("text")).alias("error"))


@query
def command_validity(spark, d):
    l = inputs.leader_log(spark, d)  # noqa: E741
    value = F.when(F.col("index") % 7 == 0, "x").otherwise(F.col("value"))
    return l.withColumn("value", value).select("index", "type", rules.command_code("type", "key", "value").alias("code"))


@query
def batch_validation(spark, d):
    return batches.validated(inputs.batches(spark, d), 6, 80)


@query
def batch_accepted(spark, d):
    return batches.accepted(inputs.batches(spark, d), 6, 80)


@query
def batch_applied_prefix(spark, d):
    rows = inputs.batches(spark, d).withColumn("ok", F.col("key") != "")
    return batches.applied_prefix(rows).select("batch_id", "ordinal", "key")


# tables -----------------------------------------------------------------------
@query
def memtable_stats(spark, d):
    return tables.memory_stats(inputs.level0(spark, d))


@query
def flush_catalog(spark, d):
    return inputs.catalog(spark, d)


@query
def table_order(spark, d):
    return tables.lookup_order(inputs.catalog(spark, d)).select("rank", "generation", "max_seq")


@query
def global_counters(spark, d):
    """Highest sequence number, next generation and file of the catalogue; zero and one without tables."""
    return inputs.catalog(spark, d).agg(F.coalesce(F.max("max_seq"), F.lit(0)).alias("max_seq"), (F.coalesce(F.max("generation"), F.lit(-1)) + 1).alias("next_generation"), F.count(F.lit(1)).alias("tables"))


@query
def rotate_by_bytes(spark, d):
    number = F.substring("key", 6, 18).cast("long")
    return tables.rotate_by_bytes(inputs.entries(spark, d), 16 << 10, number % 4)


@query
def block_index(spark, d):
    return tables.block_index(inputs.level0(spark, d), 1024)


@query
def block_contiguity(spark, d):
    return tables.block_gaps(tables.block_index(inputs.level0(spark, d), 1024).where("block <> 1"))


@query
def unsorted_rows(spark, d):
    return tables.unsorted_keys(tables.generations(inputs.entries(spark, d), inputs.CHECKPOINT), "seq")


@query
def read_merge(spark, d):
    """Memory (the last generation) over flushed tables over level 1."""
    entries = tables.generations(inputs.entries(spark, d), inputs.CHECKPOINT)
    last = F.broadcast(entries.agg(F.max("generation").alias("last")))
    split = entries.join(last)
    cut = lambda c: split.where(c).select("key", "value", "seq", "deleted")
    return state.overlay(cut(F.col("generation") == F.col("last")), cut(F.col("generation") < F.col("last")))


@query
def range_prune_counts(spark, d):
    return tables.range_prune(tables.catalogue(inputs.stored_level0(spark, d)), inputs.probes(spark, d))


@query
def bloom_sizing(spark, d):
    return bloom.sizing(inputs.catalog(spark, d))


@query
def bloom_negatives_exact(spark, d):
    l0 = inputs.stored_level0(spark, d)
    return tables.bloom_checks(tables.catalogue(l0), l0, inputs.probes(spark, d))


@query
def bloom_totals(spark, d):
    l0 = inputs.stored_level0(spark, d)
    return bloom.totals(bloom.sizing(tables.catalogue(l0)), tables.bloom_checks(tables.catalogue(l0), l0, inputs.probes(spark, d)))


@query
def bloom_may_contain(spark, d):
    """Each table's filter asked for the keys of the table before it."""
    l0 = inputs.stored_level0(spark, d)
    sized = bloom.sizing(tables.catalogue(l0))
    asked = l0.select((F.col("generation") + 1).alias("generation"), "key")
    return bloom.may_contain(bloom.filters(l0, sized), asked, sized)


@query
def bloom_false_positives(spark, d):
    """Small filters asked for the keys of the table before, so that some answers are false."""
    l0 = inputs.stored_level0(spark, d)
    sized = bloom.sizing(tables.catalogue(l0), 0.3)
    asked = l0.select((F.col("generation") + 1).alias("generation"), "key")
    return bloom.false_positives(bloom.may_contain(bloom.filters(l0, sized), asked, sized), l0)


@query
def table_write_faults(spark, d):
    """What the log itself, which repeats keys, breaks of a table's rules."""
    return bloom.refused(inputs.entries(spark, d).withColumn("seq", F.col("seq") - 1))


@query
def cache_ratio(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return by.select("user_id", "hits", "misses", bloom.cache_hit_ratio(F.col("hits"), F.col("misses")).alias("ratio"))


@query
def l0_select(spark, d):
    return tables.pick_oldest(inputs.catalog(spark, d)).select("generation", "max_seq")


@query
def l1_overlap(spark, d):
    """What the newest level-0 tables reach of level 1."""
    l0 = inputs.stored_level0(spark, d)
    newest = F.broadcast(l0.agg(F.max("generation").alias("last")))
    chosen = tables.catalogue(l0).join(newest).where(F.col("generation") > F.col("last") - inputs.NEW)
    return tables.overlap_closure(chosen, tables.catalogue(inputs.level1(l0), 1)).select("generation", "smallest_key", "largest_key")


@query
def l1_violations(spark, d):
    return tables.overlapping_neighbours(tables.catalogue(inputs.stored_level0(spark, d)))


@query
def level_counts(spark, d):
    level = lambda df, n: df.select(F.lit(n).cast("long").alias("level"))
    l0 = inputs.stored_level0(spark, d)
    both = level(tables.catalogue(l0), 0).unionByName(level(tables.catalogue(inputs.level1(l0), 1), 1))
    return tables.needs_compaction(both)


@query
def compact_l0(spark, d):
    l0 = inputs.stored_level0(spark, d)
    return tables.compact(l0, tables.pick_oldest(tables.catalogue(l0)))


@query
def compaction_counters(spark, d):
    l0 = inputs.stored_level0(spark, d)
    return tables.compaction_counters(l0, tables.pick_oldest(tables.catalogue(l0)))


@query
def tombstone_drop(spark, d):
    """A merge of every second table: older ones outside keep some tombstones."""
    l0 = inputs.stored_level0(spark, d)
    return tables.droppable(l0, tables.catalogue(l0).where(F.col("generation") % 2 == 1))


@query
def flush_live_delta(spark, d):
    """Live count change of each flush."""
    return tables.flush_deltas(inputs.level0(spark, d))


@query
def manifest_diff(spark, d):
    l0 = inputs.stored_level0(spark, d)
    old, chosen = tables.catalogue(l0).select("path", "entry_count", "max_seq"), tables.pick_oldest(tables.catalogue(l0))
    merged = tables.compact(l0, chosen)
    output = tables.catalogue(merged.withColumn("generation", F.lit(3).cast("long")), 1).select("path", "entry_count", "max_seq")
    return tables.manifest_diff(old, tables.replaced(old, chosen, output))


@query
def orphan_files(spark, d):
    """Every third table is not in the manifest."""
    cat = inputs.catalog(spark, d)
    return tables.orphans(cat.select("path"), cat.where(F.col("generation") % 3 != 0))


@query
def metadata_mismatch(spark, d):
    cat = inputs.catalog(spark, d).select("path", "generation", "entry_count", "max_seq")
    return tables.metadata_mismatches(cat, cat.where("generation <> 2").withColumn("entry_count", F.col("entry_count") + F.when(F.col("generation") % 5 == 0, 1).otherwise(0)))


@query
def stale_compaction_inputs(spark, d):
    cat = inputs.catalog(spark, d)
    return tables.stale_inputs(tables.pick_oldest(cat), cat.where("generation <> 1"))


# replication ------------------------------------------------------------------
@query
def submit_status(spark, d):
    """A follower's entries submitted again, against the leader's term and a commit index at four fifths."""
    i, n = F.col("index"), inputs.log_length(spark, d)
    sent = inputs.follower_log(spark, d).withColumn("code", F.when(i % 11 == 0, rules.command_code("type", F.lit(""), "value")).otherwise(rules.command_code("type", "key", "value")))
    sent = sent.withColumn("role", F.when(i % 13 == 0, "FOLLOWER").otherwise("LEADER")).withColumn("timeout_ms", (i % 17).cast("long"))
    now = inputs.leader_log(spark, d).select("index", F.col("term").alias("current_term"))
    told = replication.submit_status(sent.withColumnRenamed("term", "entry_term").join(now, "index").withColumn("commit_index", F.lit(n * 4 // 5).cast("long")))
    return told.select("index", "type", "status")


@query
def vote_grant(spark, d):
    return replication.vote_grants(inputs.vote_requests(spark, d)).select("voter", "term", "candidate", "granted")


@query
def vote_tally(spark, d):
    return replication.tally(replication.vote_grants(inputs.vote_requests(spark, d)), F.lit(100))


@query
def commit_index(spark, d):
    return replication.commit_index(inputs.positions(spark, d))


@query
def read_barrier(spark, d):
    p = inputs.positions(spark, d)
    nodes = p.select("cell", (F.col("match_index") % 3 != 0).alias("reachable"), F.col("entry_term").alias("committed_term"), "current_term")
    return replication.read_barrier(nodes)


@query
def replication_lag(spark, d):
    p = inputs.positions(spark, d).groupBy("cell").agg(F.max("match_index").alias("last_log_index"), F.min("match_index").alias("commit_index"))
    return replication.replication_lag(p.withColumnRenamed("cell", "node"))


@query
def log_conflict_repair(spark, d):
    return replication.repaired(inputs.follower_log(spark, d), inputs.leader_log(spark, d)).select("index", "term", "type", "value")


@query
def conflict_backoff(spark, d):
    n = inputs.log_length(spark, d)
    return replication.back_off(inputs.follower_log(spark, d), n * 8 // 10, 100)


@query
def append_batch(spark, d):
    return replication.append_batch(inputs.leader_log(spark, d), 900).select("index", "term", "type", "key")


@query
def log_gaps(spark, d):
    return replication.gaps(inputs.leader_log(spark, d).where(F.col("index") % 97 != 0))


@query
def term_lookup(spark, d):
    l, n = inputs.leader_log(spark, d), inputs.log_length(spark, d)  # noqa: E741
    parts = [replication.term_at(l, i, (100, 1)) for i in (0, 50, 100, 101, n, n + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def apply_committed(spark, d):
    return replication.state_at(inputs.leader_log(spark, d), inputs.log_length(spark, d) * 3 // 4)


@query
def snapshot_create(spark, d):
    return replication.snapshot(inputs.leader_log(spark, d), inputs.log_length(spark, d) // 2)


def _replica(spark, d) -> ReplicaStorage:
    return ReplicaStorage(spark, f"{inputs.scratch(spark)}/replica-{uuid.uuid4().hex[:12]}")


@query
def replica_log(spark, d):
    """A follower's stored log, replaced by the repaired one and loaded again."""
    stored = _replica(spark, d)
    stored.replace_log(inputs.follower_log(spark, d))
    stored.replace_log(replication.repaired(stored.log(), inputs.leader_log(spark, d).drop("node")))
    return stored.log()


@query
def replica_snapshot(spark, d):
    """A snapshot at half of the log, stored and loaded again."""
    stored, log, at = _replica(spark, d), inputs.leader_log(spark, d), inputs.log_length(spark, d) // 2
    stored.save_snapshot(at, replication.term_at(log, at).first()["term"], replication.state_at(log, at))
    index, term, rows = stored.snapshot()
    return rows.select("last_included_index", "last_included_term", "key", "value")


@query
def recover_from_snapshot(spark, d):
    l, n = inputs.leader_log(spark, d), inputs.log_length(spark, d)  # noqa: E741
    return replication.recovered(replication.snapshot(l, n // 2), l, n * 3 // 4)


@query
def snapshot_install(spark, d):
    n = inputs.log_length(spark, d)
    return replication.after_install(inputs.leader_log(spark, d), n // 2, 1 + (n // 2 - 1) // 1000).select("index", "term")


# metrics ----------------------------------------------------------------------
@query
def counters(spark, d):
    return metrics.counters(inputs.samples(spark, d))


@query
def gauges(spark, d):
    return metrics.gauges(inputs.samples(spark, d))


@query
def latency_quantiles(spark, d):
    return metrics.histograms(inputs.samples(spark, d))


@query
def histogram_ring(spark, d):
    return metrics.ring(inputs.samples(spark, d), 700)


@query
def workload_report(spark, d):
    return metrics.workload_report(inputs.requests(spark, d), 30)


@query
def prometheus_text(spark, d):
    s = inputs.samples(spark, d)
    up = lambda df, p: df.withColumn("name", F.concat(F.lit(p), F.col("name")))
    return metrics.prometheus(up(metrics.counters(s), "total_"), up(metrics.gauges(s), "last_"), metrics.histograms(s))


@query
def json_log(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("user"))
    return metrics.json_lines(e.withColumn("note", F.concat(F.lit('a "quoted"\nline of '), F.col("user"))), ["note", "user"])


@query
def status_row(spark, d):
    """One row about the store: keys, sequence, tables, entries, tombstones stored."""
    live = state.live_count(inputs.entries(spark, d)).select("live_keys")
    last = inputs.entries(spark, d).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_sequence"))
    cat = inputs.catalog(spark, d).agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("stored_entries"), F.coalesce(F.sum("tombstones"), F.lit(0)).alias("stored_tombstones"))
    return live.join(F.broadcast(last)).join(F.broadcast(cat))


# streams ----------------------------------------------------------------------
@query
def stream_state(spark, d):
    """The event log as a stream, flushed in micro-batches and read back: live keys."""
    root = f"{inputs.scratch(spark)}/stream-{uuid.uuid4().hex[:12]}"
    events_log(spark, d).write.parquet(f"{root}/log")
    q = streaming.flush_batches(streaming.read_stream(spark, f"{root}/log", 1), f"{root}/tables", f"{root}/checkpoint")
    q.awaitTermination()
    return state.live(streaming.flushed(spark, f"{root}/tables"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
