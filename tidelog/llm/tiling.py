"""Benchmark decontamination by greedy string tiling.

Words (lower-cased runs of letters, digits and underscores) of a document and a
benchmark item are tiled as in running Karp-Rabin greedy string tiling: rolling hashes
of unmarked stretches of the search length find matches, each match is extended as far
as both sides are unmarked and equal, the longest matches are marked first, and the
search length falls to ``SEED`` words. Tiles never overlap, and their order in the
document plays no part, so reordered passages count in full. A document is contaminated
by an item if tiles cover at least ``COVERAGE`` of the item's words.

Candidates: an item and a document meet where they share a hashed run of ``SEED``
words.

Ties between matches of one length go to the first in the item, then in the document.

Defined results: an item of fewer than ``SEED`` words is held by the documents that hold
its words as one run; items without words (null, empty) match nothing, nor do documents
without words; repeated ids give a row for each row of documents and of
items; extra columns are ignored; either table empty gives an empty result.

Scale: documents are scanned, not shuffled. Item seeds are taken in blocks of bounded
words; each block is one map over the documents with the block's sorted seed table, so
the memory of a task depends on neither table. Common seeds cost no pair: a document
compares only with items whose seeds could cover enough of them.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, free_name, rows
from .tokens import freeing, release

SEED, COVERAGE, BLOCK_WORDS = 5, 0.8, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
PAIRS = "item_id long, tiles int, covered long, item_words long, coverage double"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


class Vocabulary:
    """64-bit codes of words; remembers a bounded number."""

    def __init__(self, most: int = 300_000):
        self.codes: dict[str, int] = {}
        self.most = most

    def encode(self, words: list[str]) -> np.ndarray:
        import xxhash

        codes = self.codes
        if len(codes) > self.most:
            codes.clear()
        for w in set(words).difference(codes):
            codes[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of every run of n codes."""
    if len(codes) < n or n < 1:
        return np.empty(0, np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out = out * _BASE + codes[k : len(codes) - n + 1 + k]
    return out


def prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes and powers of the base, for runs of any length."""
    h, p = np.zeros(len(codes) + 1, np.uint64), np.ones(len(codes) + 1, np.uint64)
    base, x, y = int(_BASE), 0, 1
    for i, c in enumerate(codes.tolist()):
        x, y = (x * base + c) & 0xFFFFFFFFFFFFFFFF, (y * base) & 0xFFFFFFFFFFFFFFFF
        h[i + 1], p[i + 1] = x, y
    return h, p


def _runs(hashes: np.ndarray, powers: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the unmarked runs of n words, rolled from prefix hashes."""
    if len(free) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(marked[n:] == marked[:-n])
    return starts, hashes[starts + n] - hashes[starts] * powers[n]


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of at least ``least`` words, longest first."""
    least = max(1, min(least, len(item)))
    if len(doc) < least or not len(item):
        return []
    (hi, pi), (hd, pd) = prefix_hashes(item), prefix_hashes(doc)
    free_i, free_d, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    length = max(least, min(20, len(item)))
    while True:
        at_i, h_i = _runs(hi, pi, free_i, length)
        at_d, h_d = _runs(hd, pd, free_d, length)
        order = np.argsort(h_i, kind="stable")
        lo, hi_ = np.searchsorted(h_i[order], h_d, "left"), np.searchsorted(h_i[order], h_d, "right")
        found: list[tuple[int, int, int]] = []
        longest, end = 0, {}
        for k in np.flatnonzero(hi_ > lo).tolist():
            d = int(at_d[k])
            for i in at_i[order[lo[k] : hi_[k]]].tolist():
                if end.get(d - i, -1) > d:  # inside a match already found on this diagonal
                    continue
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n >= length:
                    end[d - i] = d + n
                    found.append((-n, i, d))
                    longest = max(longest, n)
        if longest > 2 * length:  # very long matches: begin again with their length
            length = longest
            continue
        heapify(found)
        while found:
            n, i, d = heappop(found)
            n = -n
            left = free_i[i : i + n] & free_d[d : d + n]
            if left.all():
                free_i[i : i + n] = free_d[d : d + n] = False
                tiles.append((i, d, n))
                continue
            # partly covered by a longer tile: what is left of it waits for its own length
            edges = np.flatnonzero(np.diff(np.concatenate([[0], left.view(np.int8), [0]])))
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if z - a >= length:
                    heappush(found, (a - z, i + a, d + a))
        if length == least:
            return tiles
        length = max(least, length // 2)


class Items:
    """A block of benchmark items with the sorted table of their seeds."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = COVERAGE, seed: int = SEED):
        vocabulary = Vocabulary()
        self.seed, self.coverage = seed, coverage
        self.ids = [i for i, _ in items]
        self.codes = [vocabulary.encode(words_of(t)) for _, t in items]
        long = [k for k, c in enumerate(self.codes) if len(c) >= seed]
        h = [rolled(self.codes[k], seed) for k in long]
        keys = np.concatenate(h) if h else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.who = keys[order], np.repeat(np.array(long, np.int64), [len(x) for x in h])[order]
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words, then by hash of all of them
        for k, c in enumerate(self.codes):
            if 0 < len(c) < seed:
                self.short.setdefault(len(c), {}).setdefault(int(rolled(c, len(c))[0]), []).append(k)

    def matches(self, codes: np.ndarray) -> list[tuple]:
        """(item_id, tiles, covered, item_words, coverage) of the items that a document holds."""
        out, n = self._whole(codes), self.seed
        h = rolled(codes, n)
        if not len(h) or not len(self.keys):
            return out
        at = np.searchsorted(self.keys, h, "left")
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h)
        for k in self._candidates(np.unique(h[hit])) if len(hit) else []:
            shared = hit[np.isin(h[hit], rolled(self.codes[k], n))]
            near = np.zeros(len(codes) + 1, np.int64)  # words that a shared seed covers
            np.add.at(near, shared, 1)
            np.add.at(near, shared + n, -1)
            inside = np.cumsum(near[:-1]) > 0
            # stretches that no shared seed covers can hold no tile: one word of none stands for each
            keep = inside | np.concatenate([[False], inside[:-1]])
            tiles = tile(self.codes[k], np.where(inside, codes, np.uint64(0))[keep], n)
            covered = sum(t[2] for t in tiles)
            share = covered / len(self.codes[k])
            if share >= self.coverage:
                out.append((self.ids[k], len(tiles), covered, len(self.codes[k]), share))
        return out

    def _whole(self, codes: np.ndarray) -> list[tuple]:
        """Items shorter than a seed whose words the document holds as one run."""
        out = []
        for n, items in sorted(self.short.items()):
            h = rolled(codes, n)
            for key in items.keys() & set(np.unique(h[np.isin(h, np.array(list(items), np.uint64))]).tolist()):
                at = np.flatnonzero(h == np.uint64(key))[0]
                out += [(self.ids[k], 1, n, n, 1.0) for k in items[key] if (codes[at : at + n] == self.codes[k]).all()]
        return out

    def _candidates(self, seeds: np.ndarray) -> list[int]:
        """Items with enough different seeds in the document to reach the coverage."""
        a, z = np.searchsorted(self.keys, seeds, "left"), np.searchsorted(self.keys, seeds, "right")
        counted = np.bincount(np.concatenate([np.unique(self.who[i:j]) for i, j in zip(a, z)]))
        # tiles of as many words as a seed reach a coverage with the fewest seeds: one for each
        return [k for k in np.flatnonzero(counted).tolist() if self._enough(k, int(counted[k]))]

    def _enough(self, k: int, seeds: int) -> bool:
        codes = self.codes[k]
        repeats = len(codes) - self.seed + 1 - len(np.unique(rolled(codes, self.seed)))  # a repeated seed counts for each place
        return (seeds + repeats) * self.seed >= self.coverage * len(codes)


def _scan(items: Items, keep: list[str], flag: str = ""):
    def run(batches):
        import pyarrow as pa

        release()
        vocabulary = Vocabulary()
        for b in rows(batches):
            found = [items.matches(vocabulary.encode(words_of(t))) for t in b.column("text").to_pylist()]
            if flag:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([bool(f) for f in found])], names=[*keep, flag])
                continue
            at = [i for i, f in enumerate(found) for _ in f]
            hits = [m for f in found for m in f]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array([m[k] for m in hits], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), *arrays], names=[*keep, "item_id", "tiles", "covered", "item_words", "coverage"])

    return run


def blocks(benchmark: DataFrame, coverage: float = COVERAGE, words: int = BLOCK_WORDS):
    """The benchmark in blocks of about so many words, one at a time on the driver."""
    n = F.greatest(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")), F.lit(1))
    sized = benchmark.select("item_id", "text", n.alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // words))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        found = sorted(((r["item_id"], r["text"] or "") for r in dealt.where(F.col("block") == k).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        yield Items(found, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, tiles, covered, item_words, coverage."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {PAIRS}"
    found = None
    for items in blocks(benchmark, coverage):
        part = docs.select("doc_id", "text").mapInArrow(freeing(_scan(items, ["doc_id"])), schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item, with their columns; one map for each benchmark block."""
    from pyspark.sql.types import BooleanType, StructType

    out, ws = docs, Workspace(docs.sparkSession, "tiling")
    for k, items in enumerate(blocks(benchmark, coverage)):
        if k:
            out = ws.stage(out, f"block-{k}")
        flag = free_name("leaked", docs.columns)
        schema = StructType([*docs.schema.fields]).add(flag, BooleanType())
        out = out.mapInArrow(freeing(_scan(items, docs.columns, flag)), schema).where(~F.col(flag)).select(*docs.columns)
    return out
