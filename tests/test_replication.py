"""Replicated logs: repair, commit, apply, snapshots, votes."""

from conftest import rows

from pyspark.sql import functions as F

from tidelog.operators import replication as r

LOG = "node string, index long, term long, type string, key string, value string"


def log(spark, *entries, node="n"):
    return spark.createDataFrame([(node, *e) for e in entries], LOG)


def test_state_from_a_log_and_from_its_snapshot(spark):
    l = log(spark, (1, 1, "PUT", "alpha", "one"), (2, 1, "PUT", "beta", "two"), (3, 1, "DELETE", "alpha", ""))  # noqa: E741
    assert rows(r.state_at(l, 3)) == [("beta", "two")]
    assert rows(r.recovered(r.snapshot(l, 2), l, 3)) == [("beta", "two")]
    assert rows(r.recovered(r.snapshot(l, 3), l, 3)) == [("beta", "two")]
    assert rows(r.duplicate_keys(r.snapshot(l, 2).union(r.snapshot(l, 2)))) == [("alpha", 2), ("beta", 2)]


def test_an_isolated_leaders_entries_are_lost(spark):
    follower = log(spark, (1, 1, "PUT", "stable", "1"), (2, 1, "PUT", "lost", "x"), (3, 1, "PUT", "lost", "y"))
    leader = log(spark, (1, 1, "PUT", "stable", "1"), (2, 2, "NOOP", "", ""), (3, 2, "PUT", "winner", "new"))
    fixed = r.repaired(follower, leader)
    assert rows(r.conflict(follower, leader)) == [(2,)]
    assert rows(r.state_at(fixed, 3)) == [("stable", "1"), ("winner", "new")]


def test_without_a_conflict_all_is_kept(spark):
    follower = log(spark, (1, 1, "PUT", "a", "1"), (2, 1, "PUT", "b", "1"), (3, 1, "PUT", "c", "1"))
    leader = log(spark, (2, 1, "PUT", "b", "1"))
    assert rows(r.repaired(follower, leader).select("index")) == [(1,), (2,), (3,)]


def test_back_off_walks_to_the_start_of_the_term(spark):
    l = log(spark, *[(i, 1 if i < 4 else 2 if i < 8 else 3, "NOOP", "", "") for i in range(1, 11)])  # noqa: E741
    assert rows(r.back_off(l, 7)) == [(2, 4)]
    assert rows(r.back_off(l, 2)) == [(1, 1)]
    assert rows(r.back_off(l, 7, 5)) == [(2, 6)]


def test_commit_index_is_the_quorums(spark):
    p = spark.createDataFrame([(1, 5, 2, 2, 1), (1, 3, 2, 2, 1), (1, 1, 1, 2, 1), (2, 5, 2, 2, 1), (2, 3, 1, 2, 1), (2, 1, 1, 2, 1), (3, 4, 2, 2, 4), (3, 4, 2, 2, 4)], "cell long, match_index long, entry_term long, current_term long, committed long")
    assert rows(r.commit_index(p)) == [(1, 3), (2, 1), (3, 4)]


def test_votes(spark):
    v = spark.createDataFrame([(2, "a", 1, 5, 2, None, 1, 5), (2, "a", 1, 4, 2, None, 1, 5), (2, "b", 1, 5, 2, "a", 1, 5), (1, "a", 9, 9, 2, None, 1, 5), (3, "b", 1, 5, 2, "a", 1, 5)], "term long, candidate string, last_term long, last_index long, own_term long, voted_for string, own_last_term long, own_last_index long")
    g = r.vote_grants(v)
    assert [x["granted"] for x in g.collect()] == [True, False, False, False, True]
    assert ("3", True) in [(str(x["term"]), x["won"]) for x in r.tally(g, F.lit(3)).collect()]


def test_terms_gaps_batches_and_install(spark):
    l = log(spark, (3, 2, "NOOP", "", ""), (4, 2, "PUT", "a", "1"), (6, 3, "PUT", "b", "1"))  # noqa: E741
    assert rows(r.gaps(l, 2)) == [("n", 6, 4)]
    assert rows(r.term_at(l, 0)) == [(0, 0)] and rows(r.term_at(l, 2, (2, 1))) == [(2, 1)] and rows(r.term_at(l, 9)) == [(9, None)]
    assert rows(r.append_batch(l, 4, 2).select("index")) == [(4,)]
    assert rows(r.after_install(l, 4, 2).select("index")) == [(6,)]
    assert rows(r.after_install(l, 4, 1)) == []
    assert r.snapshot_due(10, 0, 10) and not r.snapshot_due(9, 0, 10) and not r.snapshot_due(99, 0, 0)


def test_read_barrier(spark):
    n = spark.createDataFrame([(1, True, 2, 2), (1, True, 2, 2), (1, False, 2, 2), (2, True, 1, 2), (2, True, 1, 2), (3, True, 2, 2), (3, False, 2, 2), (3, False, 2, 2)], "cell long, reachable boolean, committed_term long, current_term long")
    assert rows(r.read_barrier(n)) == [(1, True), (2, False), (3, False)]


def test_lag_and_addresses(spark):
    n = spark.createDataFrame([("a", 9, 7), ("b", 3, 3)], "node string, last_log_index long, commit_index long")
    assert rows(r.replication_lag(n)) == [("a", 2), ("b", 0)]
    peers = spark.createDataFrame([("a", "host:1")], "node string, address string")
    assert rows(r.addressed(n.select("node"), peers)) == [("a", "host:1"), ("b", None)]
