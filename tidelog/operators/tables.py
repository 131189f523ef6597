"""Flushed tables and their catalogue: flush, layout, pruning, compaction, manifests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import WIDTH, dense_rank_of_rows, position_bucket, previous_in_key, previous_in_order, range_bounds, range_bucket, running_total, running_totals
from ..functions.rules import BLOCK_OVERHEAD, COMPACTION_TRIGGER, RECORD_OVERHEAD, octets
from .state import latest

#: Bytes that an in-memory entry takes besides key and value; depends on the platform.
ENTRY_OVERHEAD = 104


def generations(entries: DataFrame, every: int) -> DataFrame:
    """Entries with the generation of a checkpoint after every so many sequence numbers."""
    return entries.withColumn("generation", F.floor((F.col("seq") - 1) / F.lit(every)).cast("long"))


def flush(entries: DataFrame) -> DataFrame:
    """One version of each key in each generation: what a memory table writes out."""
    kept = [c for c in entries.columns if c not in ("key", "generation")]
    newest = F.max_by(F.struct(*kept), F.col("seq"))
    return entries.groupBy("generation", "key").agg(newest.alias("e")).select("generation", "key", "e.*")


def file_name(level: int | Column, file_id: Column, generation: Column) -> Column:
    """``sstable-L<level>-f<20 digits>-g<20 digits>-s<20 digits>.sst`` without the sequence part's zeros lost."""
    pad = lambda c: F.lpad(c.cast("string"), 20, "0")
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.lit("sstable-L"), level.cast("string"), F.lit("-f"), pad(file_id), F.lit("-g"), pad(generation), F.lit("-s"), pad(F.col("max_seq")), F.lit(".sst"))


def catalogue(tables: DataFrame, level: int = 0) -> DataFrame:
    """One row for each generation: counts, sequence range, key range, file name."""
    summed = tables.groupBy("generation").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if("deleted").alias("tombstones"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
    )
    return summed.withColumn("path", file_name(level, F.col("generation") + 1, F.col("generation")))


def memory_stats(tables: DataFrame, overhead: int = ENTRY_OVERHEAD) -> DataFrame:
    """For each generation: entries, live entries, and its approximate size in memory."""
    size = F.lit(overhead) + octets("key") + F.when(F.col("deleted"), 0).otherwise(octets("value"))
    return tables.groupBy("generation").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("deleted")).alias("live_entries"), F.sum(size).cast("long").alias("approximate_bytes")
    )


def _streamed(df: DataFrame, by: str, order: str, fold, schema: str) -> DataFrame:
    """A fold over each group's rows in order, one batch in memory at a time: ``fold(group)``
    has add(arrays of the batch's rows of the group) and finish(), which give output rows."""

    def run(batches) -> Iterator:
        import numpy as np
        import pandas as pd

        names, state, key = [c.split()[0] for c in schema.split(", ")], None, None
        for pdf in batches:
            out: list[tuple] = []
            groups = pdf[by].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else []
            for a, z in zip(starts, [*starts[1:], len(groups)]):
                if state is None or groups[a] != key:
                    if state is not None:
                        out += state.finish()
                    state, key = fold(groups[a]), groups[a]
                out += state.add({c: pdf[c].to_numpy()[a:z] for c in pdf.columns})
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.finish(), columns=names)

    return df.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)


class _Rotation:
    """A memory table that freezes at a size. An update replaces: it adds the difference to the
    version before, where that lies in the same table."""

    def __init__(self, store, limit: int, overhead: int):
        self.store, self.limit, self.overhead, self.generation = store, limit, overhead, 0
        self._new()

    def _new(self):
        self.entries, self.bytes, self.first, self.last = 0, 0, None, None

    def _row(self):
        return (self.store, self.generation, self.first, self.last, self.entries, self.bytes)

    def add(self, rows):
        import numpy as np

        seq, size, before, was = (rows[c] for c in ("seq", "size", "before", "was"))
        out, at, step = [], 0, 256
        while at < len(seq):
            if self.first is None:
                self.first, step = int(seq[at]), 256
            z = min(len(seq), at + step)
            inside = before[at:z] >= self.first  # the key's version before is in this table
            upto = self.bytes + np.cumsum(self.overhead + size[at:z] - np.where(inside, self.overhead + was[at:z], 0))
            full = np.flatnonzero(upto >= self.limit)
            n = int(full[0]) + 1 if len(full) else z - at
            self.entries, self.bytes, self.last = self.entries + int((~inside[:n]).sum()), int(upto[n - 1]), int(seq[at + n - 1])
            at, step = at + n, 2 * step
            if len(full):
                out.append(self._row())
                self.generation += 1
                self._new()
        return out

    def finish(self):
        return [self._row()] if self.entries else []


def rotate_by_bytes(entries: DataFrame, limit: int, store: Column, overhead: int = ENTRY_OVERHEAD) -> DataFrame:
    """store, generation, first_seq, last_seq, entries, bytes: each store freezes its memory
    table once it has reached the limit. Boundaries depend on those before, so a store is
    a sequential fold over batches, of constant memory; stores run in parallel."""
    size = (octets("key") + F.when(F.col("deleted"), 0).otherwise(octets("value"))).cast("long")
    rows = entries.select(store.cast("long").alias("store"), "seq", "key", size.alias("size"))
    linked = previous_in_key(rows.withColumn("this", F.struct("seq", "size")), "this", "prev", pos="seq")
    needed = linked.select("store", "seq", "size", F.coalesce("prev.seq", F.lit(-1)).alias("before"), F.coalesce("prev.size", F.lit(0)).alias("was"))
    return _streamed(needed, "store", "seq", lambda s: _Rotation(s, limit, overhead), "store long, generation long, first_seq long, last_seq long, entries long, bytes long")


class _Packing:
    """Records into blocks: a new one when the record would pass the target. The end of each
    block is looked up in the running sum of sizes."""

    def __init__(self, generation, target: int):
        self.generation, self.target, self.block, self.offset, self.n = generation, target, 0, 0, 0

    def add(self, rows):
        import numpy as np

        keys, upto, out, at = rows["key"], np.concatenate([[0], np.cumsum(rows["size"])]), [], 0
        while at < len(keys):
            if not self.n:
                self.first, self.size, least = keys[at], BLOCK_OVERHEAD, at + 1
            else:
                least = at
            end = max(least, int(np.searchsorted(upto, upto[at] + self.target - self.size, "right")) - 1)
            if end > at:
                self.last, self.size, self.n = keys[end - 1], self.size + int(upto[end] - upto[at]), self.n + end - at
            if end < len(keys):
                out += self.finish()
                self.block, self.offset, self.n = self.block + 1, self.offset + self.size, 0
            at = end
        return out

    def finish(self):
        return [(self.generation, self.block, self.first, self.last, self.offset, self.size, self.n)] if self.n else []


def block_index(tables: DataFrame, target: int) -> DataFrame:
    """generation, block, first_key, last_key, block_offset, block_size, entries of sorted tables."""
    size = (F.lit(RECORD_OVERHEAD) + octets("key") + F.when(F.col("deleted"), 0).otherwise(octets("value"))).cast("long")
    rows = tables.select("generation", "key", size.alias("size"))
    schema = "generation long, block long, first_key string, last_key string, block_offset long, block_size long, entries long"
    return _streamed(rows, "generation", "key", lambda g: _Packing(g, target), schema)


def block_gaps(index: DataFrame) -> DataFrame:
    """Blocks that do not begin where the one before ends."""
    end = F.lag(F.col("block_offset") + F.col("block_size"), 1, 0).over(Window.partitionBy("generation").orderBy("block"))
    return index.withColumn("expected", end).where("block_offset <> expected").select("generation", "block", "block_offset", "expected")


def unsorted_keys(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Rows of a table whose key is not above the one before it."""
    found = previous_in_key(rows.select("generation", order, "key"), "key", "before", key="generation", pos=order, width=width)
    return found.where("before is not null and key <= before").select("generation", order, "key")


# key ranges -------------------------------------------------------------------
def _points(df: DataFrame, key: str, rank: int, **counts) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.lit(rank).alias("rank"), *(c.cast("long").alias(n) for n, c in counts.items()))


def _probed(probes: DataFrame) -> DataFrame:
    """Each probed key once, with how often."""
    return probes.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def range_prune(catalog: DataFrame, probes: DataFrame) -> DataFrame:
    """key, covering, pruned: tables whose key range holds each probe. A sweep over sorted
    bounds and different probes, in sampled key ranges: no pair of probe and table is formed."""
    zero, one = F.lit(0), F.lit(1)
    every = _points(catalog, "smallest_key", 0, starts=one, ends=zero).union(_points(_probed(probes), "key", 1, starts=zero, ends=zero)).union(_points(catalog, "largest_key", 2, starts=zero, ends=one))
    summed = every.groupBy("key", "rank").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    bucket = range_bucket("key", range_bounds(every, "key"))
    swept = running_totals(summed, {"began": "starts", "ended": "ends"}, ["key", "rank"], bucket).where("rank = 1")
    total = catalog.agg(F.count(F.lit(1)).alias("tables"))
    covering = F.coalesce(F.col("began") - F.col("ended"), F.lit(0))
    found = probes.select("key").join(swept.select("key", "began", "ended"), "key", "left").join(F.broadcast(total))
    return found.select("key", covering.alias("covering"), (F.col("tables") - covering).alias("pruned"))


def bloom_checks(catalog: DataFrame, tables: DataFrame, probes: DataFrame) -> DataFrame:
    """generation, checks, negatives: probes within each table's range, and those of them that
    the table lacks (what an exact filter would turn away)."""
    often, none, g = _probed(probes), F.lit(None), F.col("generation")
    every = _points(catalog, "smallest_key", 0, probes=F.lit(0), tie=g).union(_points(often, "key", 1, probes=F.col("n"), tie=none)).union(_points(catalog, "largest_key", 2, probes=F.lit(0), tie=g))
    bucket = range_bucket("key", range_bounds(every, "key"))
    swept = running_total(every, "probes", ["key", "rank", "tie"], bucket, "seen").where("rank <> 1")
    checks = swept.groupBy(F.col("tie").alias("generation")).agg((F.max(F.when(F.col("rank") == 2, F.col("seen"))) - F.max(F.when(F.col("rank") == 0, F.col("seen")))).alias("checks"))
    hits = often.join(tables.select("generation", "key"), "key").groupBy("generation").agg(F.sum("n").alias("hits"))
    return checks.join(hits, "generation", "left").select("generation", "checks", (F.col("checks") - F.coalesce("hits", F.lit(0))).alias("negatives"))


def overlap_closure(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose range meets the selected tables' joint range, which grows by what it
    takes, until nothing is added. The joint range is one row; each pass is an aggregate."""
    low, high = selected.agg(F.min("smallest_key"), F.max("largest_key")).first()
    if low is None:
        return candidates.limit(0)
    while True:
        met = candidates.where((F.col("smallest_key") <= high) & (F.col("largest_key") >= low))
        a, z = met.agg(F.min("smallest_key"), F.max("largest_key")).first()
        if a is None or (a >= low and z <= high):
            return met
        low, high = min(low, a), max(high, z)


def overlapping_neighbours(catalog: DataFrame) -> DataFrame:
    """Tables of a level that must not overlap and do: previous largest key >= smallest key."""
    bucket = range_bucket("smallest_key", range_bounds(catalog, "smallest_key"))
    found = previous_in_order(catalog, "largest_key", "previous_largest", ["smallest_key", "generation"], bucket)
    return found.where("previous_largest >= smallest_key").select("generation", "smallest_key", "previous_largest")


# compaction -------------------------------------------------------------------
def pick_oldest(catalog: DataFrame, n: int | None = COMPACTION_TRIGGER) -> DataFrame:
    """The n oldest tables by (max_seq, generation); all of them if n is None (forced)."""
    return catalog if n is None else catalog.orderBy("max_seq", "generation").limit(n)


def lookup_order(catalog: DataFrame) -> DataFrame:
    """rank, generation, ...: the order in which tables are looked at: newest first."""
    order = [F.desc("max_seq"), F.desc("generation"), F.desc("path")]
    return dense_rank_of_rows(catalog, order, position_bucket(-F.col("max_seq")), "rank")


def merge(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """Newest version of each key among the selected tables (a tie: the oldest table's)."""
    inputs = tables.join(selected.select("generation"), "generation", "left_semi")
    return latest(inputs, [F.col("seq"), -F.col("generation")])


def _judged(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """key, value, seq, deleted, inputs, droppable of each key in the selected tables: its newest
    version among them (a tie: the oldest table's), its entries there, and whether it is a
    tombstone that no live entry outside, not newer, still needs. One shuffle by key."""
    marked = tables.join(selected.select("generation").distinct().withColumn("chosen", F.lit(1)), "generation", "left")
    chosen = F.col("chosen").isNotNull()
    newest = F.max_by(F.struct("value", "seq", "deleted"), F.when(chosen, F.struct(F.col("seq"), -F.col("generation"))))
    oldest = F.min(F.when(~chosen & ~F.col("deleted"), F.col("seq")))
    summed = marked.groupBy("key").agg(newest.alias("e"), F.count("chosen").alias("inputs"), oldest.alias("oldest")).where("inputs > 0")
    shadowed = F.coalesce(F.col("oldest") <= F.col("e.seq"), F.lit(False))
    return summed.select("key", "e.*", "inputs", (F.col("e.deleted") & ~shadowed).alias("droppable"))


def droppable(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """key, seq, droppable for the tombstones of a merge: kept while a table outside holds a
    live entry of the key that is not newer."""
    return _judged(tables, selected).where("deleted").select("key", "seq", "droppable")


def compact(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """The compacted table: merged entries without droppable tombstones."""
    return _judged(tables, selected).where("not droppable").select("key", "value", "seq", "deleted")


def compaction_counters(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: input and output tables and entries, and tombstones dropped."""
    chosen = selected.agg(F.count(F.lit(1)).alias("input_tables"))
    summed = _judged(tables, selected).agg(F.coalesce(F.sum("inputs"), F.lit(0)).alias("input_entries"), F.count(F.lit(1)).alias("merged"), F.count_if("droppable").alias("tombstones_dropped"))
    out = F.col("merged") - F.col("tombstones_dropped")
    return chosen.join(F.broadcast(summed)).select(
        "input_tables", F.when(out > 0, 1).otherwise(0).cast("long").alias("output_tables"), "input_entries", out.alias("output_entries"), "tombstones_dropped"
    )


def needs_compaction(catalog: DataFrame, trigger: int = COMPACTION_TRIGGER) -> DataFrame:
    """level, tables, due: tables of each level; level 0 is due at the trigger."""
    return catalog.groupBy("level").agg(F.count(F.lit(1)).alias("tables")).withColumn("due", (F.col("level") == 0) & (F.col("tables") >= trigger))


def flush_delta(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """One row: change of the live key count when a table is flushed onto a state."""
    was, now = F.col("was").isNotNull(), ~F.col("deleted")
    change = F.when(now & ~was, 1).when(~now & was, -1).otherwise(0)
    return incoming.select("key", "deleted").join(state.select("key", F.lit(1).alias("was")), "key", "left").agg(F.coalesce(F.sum(change), F.lit(0)).cast("long").alias("live_delta"))


def flush_deltas(tables: DataFrame) -> DataFrame:
    """generation, live_delta: the change of the live key count at each flush, onto all before."""
    found = previous_in_key(tables.select("generation", "key", "deleted"), "deleted", "before", pos="generation")
    was, now = ~F.coalesce("before", F.lit(True)), ~F.col("deleted")
    change = F.when(now & ~was, 1).when(~now & was, -1).otherwise(0)
    return found.groupBy("generation").agg(F.sum(change).cast("long").alias("live_delta"))


# manifests --------------------------------------------------------------------
def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (ADDED, REMOVED, KEPT, CHANGED) between two manifests."""
    a, b = old.select("path", F.struct(*[c for c in old.columns if c != "path"]).alias("a")), new.select("path", F.struct(*[c for c in old.columns if c != "path"]).alias("b"))
    status = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "KEPT").otherwise("CHANGED")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def replaced(active: DataFrame, selected: DataFrame, output: DataFrame) -> DataFrame:
    """The table set after a compaction: active without selected, with the output."""
    return active.join(selected.select("path"), "path", "left_anti").unionByName(output)


def stale_inputs(selected: DataFrame, active: DataFrame) -> DataFrame:
    """Compaction inputs that are no longer active (must be none to publish)."""
    return selected.join(active.select("path"), "path", "left_anti").select("path")


def orphans(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files that no manifest row names."""
    return listing.join(manifest.select("path"), "path", "left_anti").select("path")


def metadata_mismatches(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows whose file is missing or differs in any column both have."""
    columns = [c for c in manifest.columns if c in found.columns and c != "path"]
    pair = manifest.alias("m").join(found.alias("f"), "path", "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    return pair.where(~same).select("path")


def catalogue_of_files(stored: DataFrame, level: str = "L0") -> DataFrame:
    """Manifest rows for files that none names yet: each file of a stored table becomes one
    of the level, numbered in order of its highest sequence number."""
    summed = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path")).agg(
        F.count(F.lit(1)).alias("entry_count"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key")
    )
    numbered = dense_rank_of_rows(summed, ["max_seq", "path"], position_bucket("max_seq"), "generation")
    return numbered.select("path", F.lit(level).alias("level"), "generation", "entry_count", "min_seq", "max_seq", "smallest_key", "largest_key")


def short_files(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """path, entry_count, found of tables whose rows are not as many as the manifest says."""
    rows = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path")).agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0))
    return manifest.join(rows, "path", "left").where(F.col("entry_count") != found).select("path", "entry_count", found.alias("found"))
