"""Fingerprints, bit-sliced search and groups against brute force."""

import re

import numpy as np
import xxhash
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import documents, empty

from tidelog.llm import simhash
from tidelog.llm.components import connected
from tidelog.llm.queries import op7_simhash_near_duplicates
from tidelog.llm.store import Workspace


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)] or [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def groups(rows):
    """{doc_id: (hex, component)} of (doc_id, text) by comparing all pairs."""
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = components(len(rows), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3).tolist())
    lowest = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            lowest[r] = min(d, lowest.get(r, d))
    return sorted(((d, f"{int(x):016x}", lowest.get(r)) for (d, _), x, r in zip(rows, f, root)), key=str)


def near_copies(n=60):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 4000)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, len(w), i % 6):
            w[at] = f"edit{i}"
        out.append((i, " ".join(w)))
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op7_simhash_near_duplicates(spark, SF)) == groups(rows)


def test_near_copies_link(spark):
    rows = near_copies()
    expect = groups(rows)
    assert len({e[2] for e in expect}) < len({e[1] for e in expect})  # some link without being equal
    assert found(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expect


def test_odd_documents(spark):
    docs = documents(spark)
    assert found(simhash.near_duplicates(docs)) == groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    expect = sorted({(c, f) if c is not None else (None, f) for _, f, c in groups(rows)}, key=str)
    got = sorted(((r["doc_id"], f"{fingerprint(r['text']):016x}") for r in kept.collect()), key=str)
    assert [g[0] for g in got] == [e[0] for e in expect if (e[0], e[1]) in got or e[0] is None] and len(got) == len({e[2] for e in groups(rows)})
    assert simhash.representatives(empty(spark)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 90), st.integers(0, 3))
def test_bit_slices_equal_distances(seed, n, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    f = base[rng.integers(0, 4, n)] ^ np.array([sum(1 << b for b in set(rng.integers(0, 64, rng.integers(0, 6)).tolist())) for _ in range(n)], dtype=np.uint64)
    flags = np.unpackbits(simhash.within(simhash.planes(f), n, f, radius), axis=1)
    distance = np.bitwise_count(f[:, None] ^ f[None, :])
    assert (flags[:, :n] == (distance <= radius)).all() and not flags[:, n:].any()
    links = np.argwhere(distance <= radius).tolist()
    assert components(n, simhash.star_edges(f, radius)) == components(n, links)
    h = n // 2
    if h:
        a, b = f[:h], f[h:]
        edges = [*simhash.star_edges(a, radius), *((x + h, y + h) for x, y in simhash.star_edges(b, radius)), *((x, y + h) for x, y in simhash.cross_edges(a, b, radius))]
        assert components(n, edges) == components(n, links)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 60), st.sampled_from([0, 1, 2, 5, 8, 40, 63, 64, 88, 127]), st.sampled_from([1, 2, 4]))
def test_counters_of_any_radius_and_width(seed, n, radius, words):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**63, (n, words), dtype=np.uint64)
    f[n // 2 :] = f[: n - n // 2] ^ (rng.integers(0, 2**63, (n - n // 2, words), dtype=np.uint64) & rng.integers(0, 2**63, (n - n // 2, words), dtype=np.uint64))
    distance = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    flags = np.unpackbits(simhash.within(simhash.planes(f), n, f, radius), axis=1)
    assert (flags[:, :n] == (distance <= radius)).all() and not flags[:, n:].any()
    assert (simhash.pairs_within(f ^ f[0], radius) == (distance[0] <= radius)).all()


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    for chunk in (1, 7, 498, 499, 1 << 17):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.text_fingerprint(text) % 2**64 == fingerprint(text)


def test_large_buckets_are_split(spark):
    """Chunks of a few fingerprints give the same components as whole buckets."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 5)
    f = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 62, rng.integers(0, 5))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in f], "fp long")
    a = np.array(f, np.uint64)
    expect = components(len(f), np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3).tolist())
    for split in (7, 4096):
        ws = Workspace(spark, "split")
        root = {r["node"]: r["root"] for r in connected(simhash.links(df, 3, split), ws).collect()}
        assert [root.get(x, x) for x in f] == [f[r] for r in expect]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (1, 2)]
    df = spark.createDataFrame(edges, "u long, v long")
    root = {r["node"]: r["root"] for r in connected(df, Workspace(spark, "cc")).collect()}
    assert set(root.values()) == {0, 1000} and len(root) == 301 + 400
    assert connected(df.limit(0), Workspace(spark, "cc")).count() == 0
