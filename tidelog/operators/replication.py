"""Replicated logs as relations: votes, commit index, repair, apply, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import WIDTH, previous_in_key
from ..functions.rules import APPEND_ENTRIES
from .state import latest


def quorum(nodes: Column) -> Column:
    return (F.floor(nodes / 2) + 1).cast("long")


def submit_status(requests: DataFrame) -> DataFrame:
    """Adds ``status`` to rows (code, role, timeout_ms, index, entry_term | current_term, commit_index):
    what a client is told of its command, from its validity, the leader's role when it came and
    the state at its deadline. A null role, timeout, term or commit index decides nothing."""
    status = (
        F.when(F.col("timeout_ms") <= 0, "TIMEOUT")
        .when(F.col("code") != "OK", "INVALID_COMMAND")
        .when(F.col("role") != "LEADER", "NOT_LEADER")
        .when(F.col("commit_index") >= F.col("index"), "COMMITTED")
        .when(F.col("current_term") != F.col("entry_term"), "NOT_LEADER")
        .otherwise("TIMEOUT")
    )
    return requests.withColumn("status", status)


def vote_grants(requests: DataFrame) -> DataFrame:
    """Adds ``granted`` to rows (term, candidate, last_term, last_index | own_term, voted_for,
    own_last_term, own_last_index): not a stale term, no other vote in it, a log as new."""
    newer = F.col("term") > F.col("own_term")
    free = newer | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    fresh = F.struct("last_term", "last_index") >= F.struct(F.col("own_last_term"), F.col("own_last_index"))
    return requests.withColumn("granted", (F.col("term") >= F.col("own_term")) & free & fresh)


def tally(grants: DataFrame, nodes: Column) -> DataFrame:
    """term, candidate, votes, won: granted votes and the candidate's own against the quorum."""
    votes = (F.count_if("granted") + 1).cast("long")
    summed = grants.groupBy("term", "candidate").agg(votes.alias("votes"), F.max(nodes).alias("nodes"))
    return summed.select("term", "candidate", "votes", (F.col("votes") >= quorum(F.col("nodes"))).alias("won"))


def commit_index(positions: DataFrame) -> DataFrame:
    """cell, commit_index from rows (cell, match_index, entry_term, current_term, committed):
    the highest index that a quorum holds, the leader's own last index among the rows,
    taken only if it moves ahead and its entry is of the current term."""
    n = F.count(F.lit(1))
    by = positions.groupBy("cell").agg(
        n.alias("n"),
        F.array_sort(F.collect_list(F.struct("match_index", "entry_term"))).alias("m"),  # one element for each node of a cell
        F.max("current_term").alias("current_term"),
        F.max("committed").alias("committed"),
    )
    at = F.element_at("m", (F.col("n") - quorum(F.col("n")) + 1).cast("int"))
    advance = (at["match_index"] > F.col("committed")) & (at["entry_term"] == F.col("current_term"))
    return by.select("cell", F.when(advance, at["match_index"]).otherwise(F.col("committed")).alias("commit_index"))


def replication_lag(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", (F.col("last_log_index") - F.col("commit_index")).alias("lag"))


def read_barrier(nodes: DataFrame) -> DataFrame:
    """cell, readable: a quorum answers and an entry of the current term is committed."""
    return nodes.groupBy("cell").agg(
        ((F.count_if("reachable") >= quorum(F.count(F.lit(1)))) & (F.max("committed_term") == F.max("current_term"))).alias("readable")
    )


def conflict(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """One row ``at``: the least index that both have with different terms (null: none)."""
    both = follower.select("index", F.col("term").alias("f")).join(leader.select("index", F.col("term").alias("l")), "index")
    return both.where("f <> l").agg(F.min("index").alias("at"))


def repaired(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """The follower's log after the leader's batch: cut at a conflict and continued by the
    leader; without one, all is kept and only missing entries are appended."""
    at = F.broadcast(conflict(follower, leader))  # one row
    kept = follower.join(at).where(F.col("at").isNull() | (F.col("index") < F.col("at"))).drop("at")
    new = leader.join(kept.select("index"), "index", "left_anti").select(*follower.columns)
    return kept.unionByName(new)


def back_off(follower: DataFrame, index: int, snapshot_index: int = 0) -> DataFrame:
    """One row: term found at ``index`` and the first index of its run of that term, not
    below the entry after the snapshot. Null if there is no such entry."""
    here = F.broadcast(follower.where(F.col("index") == index).select(F.col("term").alias("t")))
    other = follower.where(F.col("index") < index).join(here).where("term <> t").agg(F.max("index").alias("before"))
    first = follower.where(F.col("index") > snapshot_index).agg(F.min("index").alias("lowest"))
    start = F.greatest(F.coalesce(F.col("before") + 1, F.col("lowest")), F.lit(snapshot_index + 1))
    return here.join(F.broadcast(other)).join(F.broadcast(first)).select(F.col("t").alias("conflict_term"), start.cast("long").alias("conflict_index"))


def append_batch(leader: DataFrame, next_index: int, most: int = APPEND_ENTRIES) -> DataFrame:
    """The entries sent next: up to ``most`` from an index. A range, since indices are contiguous."""
    return leader.where((F.col("index") >= next_index) & (F.col("index") < next_index + most))


def gaps(log: DataFrame, snapshot_index: int = 0, width: int = WIDTH) -> DataFrame:
    """node, index of entries that do not follow the one before (or the snapshot). A node's
    log is dealt over index buckets."""
    found = previous_in_key(log.select("node", "index"), "index", "last", key="node", pos="index", width=width)
    before = F.coalesce("last", F.lit(snapshot_index).cast("long"))
    return found.withColumn("before", before).where(F.col("index") != F.col("before") + 1).select("node", "index", "before")


def term_at(log: DataFrame, index: int, snapshot: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row: the term of an index: 0 at index 0, the snapshot's at its index, null outside."""
    found = log.where((F.col("index") == index) & (F.col("index") > snapshot[0])).agg(F.max("term").alias("term"))
    known = F.lit(0) if index == 0 else F.lit(snapshot[1]) if index == snapshot[0] else F.col("term")
    return found.select(F.lit(index).cast("long").alias("index"), known.cast("long").alias("term"))


def applied(log: DataFrame, commit: int, after: int = 0) -> DataFrame:
    """Entries (key, value, seq, deleted) of the committed commands after an index, by log index; no-ops fall out."""
    rows = log.where((F.col("index") > after) & (F.col("index") <= commit) & (F.col("type") != "NOOP"))
    return rows.select("key", "value", F.col("index").alias("seq"), (F.col("type") == "DELETE").alias("deleted"))


def state_at(log: DataFrame, commit: int) -> DataFrame:
    """key, value of live keys after all commands up to a commit index."""
    return latest(applied(log, commit)).where(~F.col("deleted")).select("key", "value")


def snapshot_due(applied_index: int, last_snapshot: int, threshold: int) -> bool:
    """A threshold of 0 turns snapshots off."""
    return bool(threshold) and applied_index - last_snapshot >= threshold


def snapshot(log: DataFrame, index: int) -> DataFrame:
    """last_included_index, last_included_term, key, value: the state at an index."""
    term = F.broadcast(log.where(F.col("index") == index).agg(F.max("term").alias("last_included_term")))
    return state_at(log, index).join(term).select(F.lit(index).cast("long").alias("last_included_index"), "last_included_term", "key", "value")


def recovered(snap: DataFrame, log: DataFrame, commit: int) -> DataFrame:
    """key, value of live keys from a snapshot and the committed entries after it.

    Entries between the snapshot and what a node had applied are never lost: state is
    always the snapshot with the suffix up to the commit index."""
    last = F.broadcast(snap.agg(F.coalesce(F.max("last_included_index"), F.lit(0)).alias("after")))
    base = snap.select("key", "value", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"))
    suffix = applied(log, commit).join(last).where(F.col("seq") > F.col("after")).drop("after")
    return latest(base.unionByName(suffix)).where(~F.col("deleted")).select("key", "value")


def after_install(log: DataFrame, index: int, term: int) -> DataFrame:
    """The log that stays after a snapshot is installed: what follows its index if the log
    has the snapshot's entry with its term, else nothing."""
    matches = F.broadcast(log.where((F.col("index") == index) & (F.col("term") == term)).agg(F.count(F.lit(1)).alias("m")))
    return log.where(F.col("index") > index).join(matches).where("m > 0").drop("m")


def duplicate_keys(snap: DataFrame) -> DataFrame:
    """Keys that a snapshot holds more than once (it is refused then)."""
    return snap.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def addressed(rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Rows with the address of their node (peers: node, address); null for unknown nodes."""
    return rows.join(peers, "node", "left")
