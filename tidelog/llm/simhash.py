"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: every document's words are hashed by shingle (XXH64); a bit is set where
over half of the hashes have it. Two fingerprints link at ``RADIUS`` or fewer differing
bits; groups are the connected components.

Search is exact: the 64 bits are cut into ``BLOCKS`` stretches; fingerprints at most
RADIUS apart agree on at least BLOCKS - RADIUS stretches, so all pairs meet under some
choice of that many stretches (10 tables of 25 or 26 bits). Rows of a bucket are
compared bit-sliced: bit planes stand vertically, the differing bits of many pairs are
added plane by plane with carry-save counters (ones, twos, over), and a block is left
as soon as every pair is over the radius. Each bucket gives the edges of a spanning
star of its components, never all its pairs.

Defined results: null, empty or wordless texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle; repeated and null ids keep a row
each; a component takes its smallest id (null only if all its ids are null); extra
columns are ignored; an empty table gives an empty result.

Scale: equal fingerprints are one class before any search. A bucket of more than
``SPLIT`` fingerprints is dealt into chunks and compared chunk against chunk, so no task
holds it whole. Components come from alternating star contraction over staged edges.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .components import ROUNDS, connected
from .store import Workspace, doc_texts, free_name, rows
from .tokens import release

SHINGLE, SEED, RADIUS, BLOCKS, SPLIT = 3, 42, 3, 5, 4096
#: Shingles of a text hashed together.
CHUNK = 1 << 17


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):  # bounded memory for very long texts
        part = words[at : at + CHUNK + shingle - 1]
        joined = [b" ".join(part)] if len(words) < shingle else list(map(b" ".join, zip(*(part[i:] for i in range(shingle)))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(joined))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches):
        import pyarrow as pa

        release()
        for b in rows(batches):
            found = [text_fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit)."""
    return doc_texts(docs).mapInArrow(_fingerprints(shingle), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def planes(words: np.ndarray) -> np.ndarray:
    """The bit planes of some fingerprints (a row of one or several 64-bit words each), packed: plane k holds bit k of each."""
    w = np.ascontiguousarray(words, ">u8").reshape(len(words), -1)
    return np.packbits(np.unpackbits(w.view(np.uint8).reshape(len(w), -1), axis=1).T, axis=1)


def within(rows_of_planes: np.ndarray, n: int, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed flags, a row for each query: which of n fingerprints differ in at most radius bits.

    Carry-save addition of the difference planes into bit-sliced counters (ones, twos,
    fours, ...) of as many levels as the radius needs; over marks lanes whose count left
    them, or is over the radius at the end."""
    bits, width = rows_of_planes.shape
    q = np.ascontiguousarray(queries, ">u8").reshape(len(queries), -1)
    masks = (-np.unpackbits(q.view(np.uint8).reshape(len(q), -1), axis=1).astype(np.int8)).view(np.uint8)
    shape = (len(q), width)
    counters = [np.zeros(shape, np.uint8) for _ in range(radius.bit_length())]
    over = np.zeros(shape, np.uint8)
    over[:, -1] = (1 << -n % 8) - 1  # lanes beyond the last fingerprint
    for k in range(bits):
        carry = rows_of_planes[k][None, :] ^ masks[:, k, None]
        for c in counters[: (k + 1).bit_length()]:
            c ^= carry
            carry = carry & ~c
        if k + 1 >= 1 << len(counters):
            over |= carry
        if k % 16 == 15 and over.min(initial=255) == 255:
            return ~over  # every pair of the block is over the radius
    even = ~over  # lanes whose higher levels equal the radius's
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            even &= counters[level]
        else:
            over |= even & counters[level]
            even &= ~counters[level]
    return ~over


def pairs_within(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For XORs of pairs (of one or several words): which have at most radius bits, by the same counters."""
    p = planes(x)
    return np.unpackbits(within(p, len(x), np.zeros((1, len(p) // 64), np.uint64), radius)[0])[: len(x)].astype(bool)


def small_pairs(keys: np.ndarray, member: np.ndarray, words: np.ndarray, most: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius in small groups, all side by side: rows at a distance of s
    in an array sorted by key; member: rows of groups of at most ``most`` rows."""
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in range(1, most):
        at = np.flatnonzero(member[:-s] & (keys[s:] == keys[:-s]))
        if len(at):
            at = at[pairs_within(words[at] ^ words[at + s], radius)]
            i.append(at)
            j.append(at + s)
    return np.concatenate(i), np.concatenate(j)


def whole_groups(batches, columns):
    """Tuples of arrays (the key first) that hold whole groups, from batches sorted by key."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = columns(b)
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        last = np.searchsorted(now[0], now[0][-1], "left")  # the last group may go on
        if last:
            yield tuple(x[:last] for x in now)
        held = tuple(x[last:] for x in now)
    if held is not None and len(held[0]):
        yield held


def star_edges(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (root, member) that connect each component of one group's links."""
    n, edges = len(fps), []
    p = planes(fps)
    free = np.ones(n, bool)
    for seed in range(n):
        if not free[seed]:
            continue
        free[seed] = False
        front = np.array([seed])
        while len(front):
            met = np.zeros(p.shape[1], np.uint8)
            for i in range(0, len(front), 128):
                met |= np.bitwise_or.reduce(within(p, n, fps[front[i : i + 128]], radius), axis=0)
            front = np.flatnonzero(np.unpackbits(met)[:n].astype(bool) & free)
            free[front] = False
            edges += [(seed, j) for j in front.tolist()]
    return edges


def cross_edges(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between two chunks that keep their components: for each of a, its first in b,
    and for each of b, its first in a; further links of a row join through the chunks' own
    components only if they share one, so every component of b that a row meets is kept."""
    own = np.arange(len(b))
    for i, j in star_edges(b, radius):
        own[j] = i  # members carry their root
    edges, p = [], planes(b)
    for i in range(0, len(a), 128):
        hits = np.unpackbits(within(p, len(b), a[i : i + 128], radius), axis=1)[:, : len(b)]
        q, r = np.nonzero(hits)
        if len(q):
            found = np.unique(np.stack([q, own[r]], 1), axis=0)
            edges += [(int(x) + i, int(y)) for x, y in found]
    return edges


def _linked(radius: int):
    """Edges between fingerprints from rows sorted by (table, bucket, pair of chunks)."""

    def group(sides, fps, lo, hi):
        f, s = fps[lo:hi], sides[lo:hi]
        if (s == 0).all():
            return [(f[i], f[j]) for i, j in star_edges(f, radius)]
        a, b = f[s == 1], f[s == 2]
        return [(a[i], b[j]) for i, j in cross_edges(a, b, radius)] if len(a) and len(b) else []

    def edges_of(keys, sides, fps):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        small = (sizes <= 32) & (sides[starts] == 0)
        i, j = small_pairs(keys, np.repeat(small, sizes), fps, int(sizes[small].max(initial=1)), radius)
        u, v = [fps[i]], [fps[j]]
        for lo, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            found = group(sides, fps, lo, lo + n)
            if found:
                e = np.array(found, np.uint64)
                u.append(e[:, 0])
                v.append(e[:, 1])
        return np.concatenate(u), np.concatenate(v)

    def run(batches):
        import pyarrow as pa

        columns = lambda b: (*(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side")), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        for whole in whole_groups(batches, columns):
            u, v = edges_of(*whole)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def chunked(dealt: DataFrame, bucket: str, by: str, split: int = SPLIT) -> DataFrame:
    """Rows of the buckets that hold several, with ``key`` and ``side``: a large bucket is dealt
    into chunks by a hash of ``by``; two chunks meet under one key as sides 1 and 2, a chunk
    meets itself as side 0. Buckets of one row have no pair."""
    counted = dealt.groupBy(bucket).count().where(F.col("count") > 1)
    chunks = F.ceil(F.col("count") / split).cast("int")
    met = dealt.join(counted, bucket).withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64(by, F.lit(1)), F.col("chunks").cast("long")).cast("int"))
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    spread = met.withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(other)))
    pair = F.struct(F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return spread.select(*dealt.columns, F.xxhash64(bucket, pair).alias("key"), side.cast("int").alias("side"))


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Edges (u, v) between different fingerprints (column fp, distinct) that connect all
    that lie within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("radius: 0 to 3")
    width = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
    low = [sum(width[:i]) for i in range(BLOCKS)]
    chosen = list(combinations(range(BLOCKS), BLOCKS - radius)) if radius else [tuple(range(BLOCKS))]
    fp = F.col("fp")
    buckets = [F.xxhash64(F.lit(t), *[F.shiftrightunsigned(fp, low[i]).bitwiseAND((1 << width[i]) - 1) for i in c]) for t, c in enumerate(chosen)]
    dealt = fps.select("fp", F.explode(F.array(*buckets)).alias("bucket"))
    keyed = chunked(dealt, "bucket", "fp", split).select("fp", "key", "side")
    return keyed.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(_linked(radius), "u long, v long")


def _grouped(found: DataFrame, radius: int, ws: Workspace) -> DataFrame:
    """From rows (doc_id, fp): one row for each fingerprint: fp, lowest (its smallest id), root."""
    classes = ws.stage(found.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "classes")
    groups = connected(links(classes.select("fp"), radius), ws)  # node, root: only nodes with an edge
    named = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    groups = ws.stage(named, "groups")
    ws.drop("classes", *(f"star-{k}" for k in range(ROUNDS)))
    return groups


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, fp."""
    ws = Workspace(docs.sparkSession, "simhash")
    found = ws.stage(fingerprints(docs, shingle), "fingerprints")
    named = _grouped(found, radius, ws)
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    member = ws.stage(named.join(lowest, "root").select("fp", "component_id"), "member")
    ws.drop("groups")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(member, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "fp")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with the columns of ``docs``: one with the smallest id (of
    groups without ids, and of rows that share id and fingerprint, any one).

    Fingerprints are worked out again beside the texts, so texts move in one shuffle only,
    by id and fingerprint, where no group meets."""
    ws = Workspace(docs.sparkSession, "simhash")
    found = ws.stage(fingerprints(docs, shingle), "fingerprints")
    named = _grouped(found, radius, ws)
    low = F.lit(-(2**63)).cast("long")
    first = F.struct(F.coalesce(F.col("lowest").cast("long"), F.lit(2**63 - 1).cast("long")), "fp")
    kept = named.groupBy("root").agg(F.min_by(F.struct(F.coalesce(F.col("lowest").cast("long"), low).alias("k"), F.col("fp").alias("f")), first).alias("r"))
    key, fp = free_name("k", docs.columns), free_name("f", docs.columns)
    chosen = kept.select(F.col("r.k").alias(key), F.col("r.f").alias(fp))
    schema = StructType([*docs.schema.fields]).add(fp, LongType())
    with_fp = docs.mapInArrow(_beside(docs.columns, shingle, fp), schema).withColumn(key, F.coalesce(F.col("doc_id").cast("long"), low))
    return with_fp.join(chosen, [key, fp]).dropDuplicates([key, fp]).select(*docs.columns)


def _beside(columns: list[str], shingle: int, name: str):
    def run(batches):
        import pyarrow as pa

        release()
        for b in rows(batches):
            found = [text_fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found, pa.int64())], names=[*columns, name])

    return run
