"""SimHash near-dedup at a similarity of word shingles.

A text is the set of its runs of ``SHINGLE`` words (as in ``simhash``; fewer words give
one run). Two texts link where their sets have a Jaccard similarity of ``SIMILARITY`` or
more; groups are the connected components, and one row of each stays.

Candidates are exact, by prefix filtering: sets are sorted in one global order, and two
sets of similarity s share a run among the first n - ceil(s n) + 1 of both. Runs that are
common in a bounded sample of documents sort last, which keeps boilerplate out of the
prefixes; any order gives the same links. Candidates are compared as SimHash fingerprints
of ``WORDS`` x 64 bits, bit-sliced by the operator's counters (``simhash.within``), at
``WIDE`` bits: a bit of two sets at the similarity differs with a chance of at most 0.19
(five runs against four of them), so with independent bits a link is lost with a chance
of at most 3e-8, and below 1e-11 from ten runs on. Pairs within it are compared as whole
sets, exactly, but for pairs that others have connected.

Defined results: null, empty and wordless texts are one group; repeated and null ids keep
a row each until groups are formed; a group keeps its smallest id (of groups without ids,
and of rows that share id and text, any one); an empty table gives none.

Scale: equal sets are one class before any search. Only prefixes are shuffled; a run that
very many classes share is pre-aggregated and dealt into chunks, never one task's. Whole
sets are formed for the classes of pairs within the radius alone, found by a bit map of
bounded size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import ROUNDS, connected
from .simhash import CHUNK, SEED, chunked, pairs_within, planes, small_pairs, whole_groups, within
from .store import Workspace, free_name, rows
from .tokens import freeing, release

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Documents whose runs are counted for the order; runs in fewer than COMMON of them count as rare.
SAMPLE, COMMON, MOST = 20_000, 3, 1 << 17
#: 64-bit words of a fingerprint, and the bits in which two may differ.
WORDS, WIDE = 4, 88
MARKS = [f"w{i}" for i in range(WORDS)]
#: Rounds in which each class tries one head.
ROUNDS_OF_HEADS = 2


def text_shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, found = max(1, len(words) - shingle + 1), []
    for at in range(0, n, CHUNK):  # bounded memory for very long texts
        part = words[at : at + CHUNK + shingle - 1]
        joined = [b" ".join(part)] if len(words) < shingle else list(map(b" ".join, zip(*(part[i:] for i in range(shingle)))))
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(joined)))
    return np.unique(np.concatenate(found))


def digest(runs: np.ndarray) -> int:
    """The class of a set, as a signed integer."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes(), SEED)).view(np.int64))


def prefix(runs: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first runs in the global order (times in the sample, hash), as many as a linked set must share one of."""
    n, (p, q) = len(runs), SIMILARITY
    if not n:
        return runs
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
        weight = np.where(common[at] == runs, times[at], 0)
    return runs[np.argsort(weight, kind="stable")][: n + 1 + (-p * n) // q]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches SIMILARITY."""
    p, q = SIMILARITY
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return q * shared >= p * (len(a) + len(b) - shared)


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """The SimHash of a set in WORDS words: each run's hash is mixed once more for every further word."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(runs), CHUNK // 8):
        h = runs[at : at + CHUNK // 8]
        words = [h]
        for _ in range(1, WORDS):  # an odd multiplier and shifts: each step permutes the 64-bit words
            h = h * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
            h = h * np.uint64(0xD1342543DE82EF95)
            h = h ^ (h >> np.uint64(32))
            words.append(h)
        bits = np.unpackbits(np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(runs)).view(">u8").astype(np.uint64)


def _runs(batches):
    import pyarrow as pa

    for b in rows(batches):
        found = [text_shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["run"])


def _classes(common: np.ndarray, times: np.ndarray):
    def run(batches):
        import pyarrow as pa

        release()
        for b in rows(batches):
            sets = [text_shingles(t) for t in b.column("text").to_pylist()]
            first = [prefix(s, common, times).view(np.int64) for s in sets]
            marks = np.stack([fingerprint(s) for s in sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("txt"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(WORDS))],
                names=["doc_id", "txt", "cls", "n", "prefix", *MARKS],
            )

    return run


def _bits(size: int):
    def run(batches):
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for b in batches:
            bits[b.column("txt").to_numpy() & (size - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    return run


def _sets(packed: np.ndarray):
    """Whole sets of the texts whose bit is set."""

    def run(batches):
        import pyarrow as pa

        release()
        mask = 8 * len(packed) - 1
        for b in rows(batches):
            at = b.column("txt").to_numpy() & mask
            hit = np.flatnonzero(packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            if len(hit):
                sets = [text_shingles(t) for t in b.column("text").take(pa.array(hit)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "runs"])

    return run


def _compared(batches):
    import pyarrow as pa

    for b in batches:
        a, c = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in ("a", "b"))
        keep = pa.array([similar(x, y) for x, y in zip(a, c)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that several documents of a bounded sample hold, sorted, and in how many."""
    n = texts.count()
    share = min(1.0, SAMPLE / max(1, n))
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counted = sampled.mapInArrow(freeing(_runs), "run long").groupBy("run").count().where(F.col("count") >= COMMON)
    found = counted.orderBy(F.desc("count"), "run").limit(MOST).collect()
    runs, times = np.array([r["run"] for r in found], np.int64).view(np.uint64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(runs)
    return runs[order], times[order]


def _sizes_fit(n, m) -> np.ndarray:
    p, q = SIMILARITY
    return q * np.minimum(n, m) >= p * np.maximum(n, m)


def _near(batches):
    """The pairs (u, v) whose fingerprints, given as their difference, are within WIDE bits."""
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            keep = pa.array(pairs_within(np.stack([b.column(w).to_numpy().view(np.uint64) for w in MARKS], 1), WIDE))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


def _met(batches):
    """Pairs of a bucket's classes, of different roots, whose fingerprints are within WIDE bits
    and whose sizes and positions of the shared run leave the similarity possible."""
    import pyarrow as pa

    names = ["key", "side", "cls", "root", "n", "at"]

    def columns(b):
        return (*(b.column(c).to_numpy() for c in names), np.stack([b.column(w).to_numpy().view(np.uint64) for w in MARKS], 1))

    def large(side, words):
        a, z = (np.flatnonzero(side == s) for s in ((0, 0) if (side == 0).all() else (1, 2)))
        p = planes(words[z])
        for at in range(0, len(a) if len(z) else 0, 128):
            i, j = np.nonzero(np.unpackbits(within(p, len(z), words[a[at : at + 128]], WIDE), axis=1)[:, : len(z)])
            yield a[at + i], z[j]

    p, q = SIMILARITY
    for key, side, cls, root, n, pos, words in whole_groups(batches, columns):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        small = (sizes <= 32) & (side[starts] == 0)
        found = [small_pairs(key, np.repeat(small, sizes), words, int(sizes[small].max(initial=1)), WIDE)]
        for lo, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
            found += [(lo + i, lo + j) for i, j in large(side[lo : lo + size], words[lo : lo + size])]
        for i, j in found:
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])  # what both can share from this run on
            keep = (root[i] != root[j]) & _sizes_fit(n[i], n[j]) & ((p + q) * rest >= p * (n[i] + n[j]))
            if keep.any():
                pair = np.unique(np.sort(np.stack([cls[i[keep]], cls[j[keep]]], 1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in (0, 1)], names=["u", "v"])


def _linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    pairs = ws.stage(pairs, f"pairs-{name}")
    met = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    wanted = ws.stage(classes.select("cls", "txt").join(met, "cls").select("txt"), f"wanted-{name}")
    size = 1 << min(27, max(10, (16 * wanted.count()).bit_length()))
    packed = np.zeros(size // 8, np.uint8)
    for r in wanted.coalesce(4).mapInArrow(freeing(_bits(size)), "bits binary").collect():  # four rows of at most 16 MB
        packed |= np.frombuffer(r["bits"], np.uint8)
    sets = ws.stage(texts.select("txt", "text").mapInArrow(freeing(_sets(packed)), "cls long, runs binary").dropDuplicates(["cls"]), f"sets-{name}")
    side = lambda key, runs: sets.select(F.col("cls").alias(key), F.col("runs").alias(runs))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")
    edges = ws.stage(both.mapInArrow(freeing(_compared), "u long, v long"), f"edges-{name}")
    ws.drop(f"pairs-{name}", f"wanted-{name}", f"sets-{name}")
    return edges


def _tried(shared: DataFrame, classes: DataFrame, groups: DataFrame | None, tried: DataFrame | None) -> DataFrame:
    """One pair (u, v) for each class that shares a run with another group: itself and the head
    of one of its runs. A run's head is the class whose runs others hold most: a text that
    others were copied from rather than a copy with edits of its own; once pairs were tried,
    any class by hash. Pairs beyond sizes and WIDE are out."""
    if groups is None:
        named = shared.select("run", "cls", F.col("cls").alias("root"), "score")
    else:
        turn = F.xxhash64("cls", F.lit(17))
        named = shared.join(groups, F.col("cls") == F.col("node"), "left").select("run", "cls", F.coalesce("root", "cls").alias("root"), turn.alias("score"))
    heads = named.groupBy("run").agg(F.max(F.struct("score", "cls", "root")).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("run", "head")
    met = named.join(heads, "run").where(F.col("head.root") != F.col("root"))
    one = met.groupBy("cls").agg(F.max("head").alias("head")).select(F.least("cls", F.col("head.cls")).alias("u"), F.greatest("cls", F.col("head.cls")).alias("v")).distinct()
    if tried is not None:
        one = one.join(tried, ["u", "v"], "left_anti")
    side = lambda key, c: classes.select(F.col("cls").alias(key), F.col("n").alias(f"n{c}"), *(F.col(w).alias(f"{w}{c}") for w in MARKS))
    p, q = SIMILARITY
    fit = q * F.least("na", "nb") >= p * F.greatest("na", "nb")
    differ = [F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b")).alias(w) for w in MARKS]
    pairs = one.join(side("u", "a"), "u").join(side("v", "b"), "v").where(fit).select("u", "v", *differ)
    return pairs.mapInArrow(freeing(_near), "u long, v long")


def links(texts: DataFrame, classes: DataFrame, ws: Workspace, rounds: int = ROUNDS_OF_HEADS) -> DataFrame:
    """Edges (u, v) that connect the classes at SIMILARITY or more; texts: rows (txt, text), classes: (txt, cls, n, prefix, words).

    For some rounds each class is compared with one head of its runs, so a large group of
    near copies costs a pair a class; classes that this connects need no further pair. What
    is left is searched whole, so the number of rounds changes the work, not the links."""
    runs = classes.select("cls", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "run"))
    held = runs.groupBy("run").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("times")).where("lo < hi").select("run", "times")
    met = ws.stage(runs.join(held, "run"), "met")
    scores = met.groupBy("cls").agg(F.sum("times").alias("score"))
    shared = ws.stage(met.drop("times").join(scores, "cls"), "shared")
    ws.drop("met")
    edges, groups, tried = None, None, None
    for k in range(rounds):
        pairs = ws.stage(_tried(shared, classes, groups, tried), f"tried{k}")
        more = _linked(pairs, texts, classes, ws, f"head{k}")
        edges, tried = (more, pairs) if edges is None else (edges.union(more), tried.union(pairs))
        groups = ws.stage(connected(edges, ws, f"near{k}-"), f"near{k}")
        ws.drop(*(f"near{k}--{i}" for i in range(ROUNDS)))
    named = shared.join(groups, F.col("cls") == F.col("node"), "left").select("run", "cls", "n", "at", F.coalesce("root", "cls").alias("root"))
    apart = named.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("run")
    rest = ws.stage(named.join(apart, "run").join(classes.select("cls", *MARKS), "cls"), "rest")
    keyed = chunked(rest, "run", "cls").select("key", "side", "cls", "root", "n", "at", *MARKS)
    met = keyed.repartition("key").sortWithinPartitions("key", "side", "cls").mapInArrow(freeing(_met), "u long, v long").distinct()
    edges = edges.union(_linked(met.join(tried, ["u", "v"], "left_anti"), texts, classes, ws, "rest"))
    ws.drop("shared", "rest", *(f"{x}{k}" for x in ("near", "tried") for k in range(rounds)))
    return edges


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    ws = Workspace(docs.sparkSession, "shingles")
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("txt"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, txt long, cls long, n long, prefix array<long>, " + ", ".join(f"{w} long" for w in MARKS)
    every = ws.stage(texts.mapInArrow(freeing(_classes(*_common(texts))), schema), "prefixes")
    classes = ws.stage(every.drop("doc_id").dropDuplicates(["cls"]), "classes")
    found = ws.stage(every.select("doc_id", "txt", "cls"), "members")
    ws.drop("prefixes")
    groups = connected(links(texts, classes, ws), ws)  # node, root: only nodes with an edge
    ws.drop("classes")
    low, high = (F.lit(x).cast("long") for x in (-(2**63), 2**63 - 1))
    named = found.select("doc_id", "txt", "cls").join(groups, F.col("cls") == F.col("node"), "left")
    first = F.struct(F.coalesce(F.col("doc_id").cast("long"), high), "txt")
    kept = named.groupBy(F.coalesce("root", "cls")).agg(F.min_by(F.struct(F.coalesce(F.col("doc_id").cast("long"), low).alias("k"), "txt"), first).alias("r"))
    key, txt = free_name("k", docs.columns), free_name("txt", docs.columns)
    chosen = ws.stage(kept.select(F.col("r.k").alias(key), F.col("r.txt").alias(txt)), "chosen")
    ws.drop("members", *(f"star-{k}" for k in range(ROUNDS)))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), low)).withColumn(txt, F.xxhash64(body))
    return keyed.join(chosen, [key, txt]).dropDuplicates([key, txt]).select(*docs.columns)
