"""Groups at five-word similarity 0.8 against all pairs."""

import corpus_pipeline
import numpy as np
from conftest import SF
from llm.odd import documents, empty
from llm.test_simhash import components

from tidelog.llm import shingles


def runs(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """The rows' groups by comparing all pairs."""
    s = [runs(t) for _, t in rows]
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return components(len(rows), [(i, j) for i in range(len(s)) for j in range(i) if linked(s[i], s[j])])


def kept(rows):
    lowest = {}
    for (d, _), g in zip(rows, groups(rows)):
        lowest[g] = min(lowest.get(g, d), d)
    return sorted(lowest.values())


def near_copies():
    """Pairs on both sides of the similarity, most of them over 3 bits apart as fingerprints, and shared boilerplate."""
    rng = np.random.default_rng(11)
    out, line = [], [f"licence{i}" for i in range(30)]
    for k in range(40):
        w = [*(f"w{i}" for i in rng.integers(0, 3000, rng.integers(40, 200))), *(line if k % 2 else [])]
        out.append(" ".join(w))
        v = list(w)
        for at in rng.integers(0, len(v), k % 6):
            v[at] = f"edit{k}"
        out.append(" ".join(v))
    return [(i, t) for i, t in enumerate(out)]


def test_stage_finds_every_near_copy(spark):
    rows = near_copies()
    expect = kept(rows)
    assert 40 < len(expect) < 75
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == expect


def test_linked_sets_are_within_the_radius():
    """The wide radius keeps sets at the similarity, whatever their size, by far."""
    rng = np.random.default_rng(4)
    worst = 0
    for n in [5, 6, 9, 10, 14, 18, 27, 45, 90, 180, 900] * 20:
        shared = -(-8 * n // 9)  # two sets of n runs at the similarity
        every = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        a, b = every[:n], np.concatenate([every[:shared], every[n:]])
        assert shingles.similar(np.sort(a), np.sort(b))
        worst = max(worst, int(np.bitwise_count(shingles.fingerprint(a) ^ shingles.fingerprint(b)).sum()))
    assert worst < shingles.WIDE - 10


def test_large_buckets_and_rounds_change_no_link(spark, monkeypatch):
    rows = near_copies() + [(1000 + i, t) for i, (_, t) in enumerate(family())]
    expect = kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunked = shingles.chunked
    monkeypatch.setattr(shingles, "chunked", lambda df, bucket, by: chunked(df, bucket, by, 7))
    assert sorted(r["doc_id"] for r in shingles.representatives(docs).collect()) == expect


def family():
    """Copies of one text with edits of their own: most pairs of copies are below the similarity."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in rng.integers(0, 3000, 150)]
    out = [(0, " ".join(base))]
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, len(w), 1 + k % 5):
            w[at] = f"own{k}-{at}"
        out.append((k + 1, " ".join(w)))
    return out


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == kept([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert shingles.representatives(docs).count() == len(set(groups(rows)))
    assert shingles.representatives(empty(spark)).count() == 0
