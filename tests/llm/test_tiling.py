"""Tiles against a plain search, and what counts as a leak."""

import random

import numpy as np
from conftest import SF
from llm.odd import documents, empty

from tidelog.llm import tiling
from tidelog.llm.queries import op6_benchmark_tiling


def plain(p, t, least):
    """Longest common unmarked stretch first, again and again."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_equal_a_plain_search():
    random.seed(4)
    for _ in range(150):
        item = np.array(random.sample(range(1000), random.randrange(1, 70)), np.uint64)
        doc = [random.randrange(2000, 3000) for _ in range(random.randrange(60))]
        for _ in range(random.randrange(4)):
            a = random.randrange(len(item))
            at = random.randrange(len(doc) + 1)
            doc[at:at] = item[a : a + random.randrange(40)].tolist()
        found = tiling.tile(item, np.array(doc, np.uint64))
        least = min(5, len(item))
        assert sum(n for *_, n in found) == sum(n for *_, n in plain(item.tolist(), doc, least))
        used_i = [i + k for i, _, n in found for k in range(n)]
        used_d = [d + k for _, d, n in found for k in range(n)]
        assert len(set(used_i)) == len(used_i) and len(set(used_d)) == len(used_d)
        assert all((item[i : i + n] == np.array(doc[d : d + n], np.uint64)).all() for i, d, n in found)


ITEM = " ".join(f"word{i}" for i in range(40))


def leaks(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = sorted(r["doc_id"] for r in tiling.without_leaks(docs, bench).collect())
    found = {r["doc_id"]: (r["item_id"], r["tiles"], r["covered"], round(r["coverage"], 3)) for r in tiling.contaminated(docs, bench).collect()}
    assert sorted(set(range(len(texts))) - set(found)) == kept
    return found


def test_reordered_and_edited_passages(spark):
    w = ITEM.split()
    texts = [
        f"before {ITEM} after",
        f"Before, {ITEM.upper()}!",
        " ".join(["x", *w[20:], "y", *w[:20], "z"]),  # halves change places
        " ".join([*w[:20], "edit", *w[21:]]),
        " ".join([*w[:31]]),
        " ".join(w[::-1]),
        " ".join(w[:4] * 30),
        "nothing of it",
    ]
    assert leaks(spark, texts) == {0: (0, 1, 40, 1.0), 1: (0, 1, 40, 1.0), 2: (0, 2, 40, 1.0), 3: (0, 2, 39, 0.975)}


def test_repeated_words_in_an_item(spark):
    item = "one two three four five six one two three four five six seven eight"
    assert leaks(spark, [item, "one two three four five six", f"{item} {item}"], [item]) == {0: (0, 1, 14, 1.0), 2: (0, 1, 14, 1.0)}


def test_tiles_equal_a_plain_search_with_repeated_words():
    random.seed(9)
    for _ in range(1500):
        item = [random.randrange(12) for _ in range(random.randrange(1, 30))]
        doc = [random.randrange(12) for _ in range(random.randrange(30))]
        for _ in range(random.randrange(4)):
            a, at = random.randrange(len(item)), random.randrange(len(doc) + 1)
            doc[at:at] = item[a : a + random.randrange(2, 15)]
        least = random.randrange(1, 6)
        got = tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), least)
        assert sorted(got) == sorted(plain(item, doc, min(least, len(item))))


def test_short_items_match_whole_and_empty_ones_nothing(spark):
    texts = ["On it the cat sat.", "x", "the sat cat", "", "the cat x sat"]
    items = ["the cat sat", "", None, "x", "X", "one two three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = sorted(tuple(r) for r in tiling.contaminated(docs, bench).collect())
    assert found == [(0, 0, 1, 3, 3, 1.0), (1, 3, 1, 1, 1, 1.0), (1, 4, 1, 1, 1, 1.0), (4, 3, 1, 1, 1, 1.0), (4, 4, 1, 1, 1, 1.0)]
    assert sorted(r["doc_id"] for r in tiling.without_leaks(docs, bench).collect()) == [2, 3]


def test_query_equals_a_plain_search_both_ways(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    number = {}
    code = lambda t: [number.setdefault(w, len(number)) for w in tiling.words_of(t)]
    runs = lambda c: {tuple(c[i : i + 5]) for i in range(len(c) - 4)}
    texts, expect = [(d["doc_id"], code(d["text"])) for d in docs], []
    for b in bench:
        item = code(b["text"])
        for doc_id, words in texts:
            if runs(item) & runs(words):  # else there is no tile
                tiles = plain(item, words, 5)
                if (covered := sum(n for *_, n in tiles)) >= 0.8 * len(item):
                    expect.append((doc_id, b["item_id"], len(tiles), covered, len(item)))
    assert expect and sorted(tuple(r)[:5] for r in op6_benchmark_tiling(spark, SF).collect()) == sorted(expect)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, op6_benchmark_tiling(spark, SF).collect()))
    monkeypatch.setattr(tiling.blocks, "__defaults__", (tiling.COVERAGE, 400))
    assert len(list(tiling.blocks(bench))) > 2
    assert sorted(map(tuple, tiling.contaminated(docs, bench).collect())) == whole
    assert tiling.without_leaks(docs, bench).count() == docs.count() - len({r[0] for r in whole})


def test_query_finds_every_item_that_stands_whole_in_a_text(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    space = lambda t: " " + " ".join(tiling.words_of(t)) + " "
    expect = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if space(b["text"]) in space(d["text"])}
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in op6_benchmark_tiling(spark, SF).collect()}
    assert expect and {k for k, c in found.items() if c == 1.0} >= expect


def test_odd_documents(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, "same words same words same words same words"), (None, "quick brown fox jumps over the lazy")], "item_id long, text string")
    found = tiling.contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(21, 1), (22, 1), (24, None)}
    kept = tiling.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert tiling.contaminated(empty(spark), bench).count() == 0 and tiling.without_leaks(empty(spark), bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.without_leaks(docs, bench.limit(0)).count() == docs.count()
