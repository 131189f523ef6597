"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Items of one length are interchangeable, so the packing is decided on the histogram of
lengths (at most ``capacity`` entries, whatever the corpus): lengths in decreasing
order, each into the open bin with the least sufficient room, which a segment tree
over remaining capacities finds in logarithmic time. Bins with equal room are handled
as runs of bin numbers, so one step places a whole run of items. The plan is a list of
runs ``(length, first rank, items, first bin, items per bin, offset)``; an item's rank
among those of its length selects its run. The result equals item-by-item best fit
decreasing.

Defined results: null or empty text is one piece (the end id alone); longer documents
give full pieces and a last, shorter one; repeated and null ids give their own rows;
ties are broken by id, piece and digest; an empty table gives an empty result.

Scale: one pass encodes; only piece sizes and checksums are staged. Ranks come from
windows over (length, salt) with offsets from a table of at most
capacity x salts counts, so no common length meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, doc_texts, rows
from .tokens import freeing

CAPACITY, END_ID, SALTS = 4096, 1, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


class RoomTree:
    """Segment tree over remaining capacities 0..n: how many runs of open bins have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that some bin has."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:  # up to the first right sibling that has bins, then down its left edge
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, items per bin, first offset)."""
    tree, open_bins, runs, bins = RoomTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins: as many as hold the rest
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            parts = [(first, full, each)] if full else []
            if full < n:
                if rest := min(left - full * each, each):
                    parts.append((first + full, 1, rest))
                if untouched := n - full - bool(rest):
                    open_bins.setdefault(room, []).append((first + full + bool(rest), untouched))
                    tree.add(room, 1)
            for at, many, per in parts:
                runs.append((length, rank, many * per, at, per, capacity - room))
                rank, left = rank + many * per, left - many * per
                if over := room - per * length:
                    open_bins.setdefault(over, []).append((at, many))
                    tree.add(over, 1)
    return runs


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.uint32(end_id).tobytes()

    def run(batches):
        import pyarrow as pa

        from .tokens import encoder, trim

        trim()
        for b in rows(batches, 1024, 2_000_000):  # the pre-tokens of a group are held at once
            ids = b.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, data in zip(ids, encoder(path).encode(b.column("text").to_pylist())):
                data += end
                for k, at in enumerate(range(0, len(data), capacity * 4)):
                    part = data[at : at + capacity * 4]
                    crc = zlib.crc32(part)
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, crc, (crc ^ hash((doc or 0, k))) % SALTS, part if with_ids else None)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
            arrays = [pa.array(x, t) for x, t in zip(out, kinds)]
            keep = 7 if with_ids else 6
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return run


def _placer(runs: Iterable[tuple]):
    """Looks up each ranked item's run by binary search."""
    table = np.array(list(runs), np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    span = int((table[:, 1] + table[:, 2]).max(initial=1)) + 1
    keys = table[:, 0] * span + table[:, 1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            k = rank - table[at, 1]
            per = np.maximum(table[at, 4], 1)
            sequence, offset = table[at, 3] + k // per, table[at, 5] + (k % per) * length
            kept = [c for c in b.schema.names if c not in ("rank", "salt")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, lasting: bool = True) -> DataFrame:
    """One row per piece with its sequence and place; ``with_ids`` adds the ids themselves.

    ``lasting``: workers keep the tokenizer and what it learned between tasks; other
    operators' stages leave more workers than run at once, and each would keep one."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    schema = PIECES + (", ids binary" if with_ids else "")
    encode = _pieces(path, capacity, end_id, with_ids)
    pieces = ws.stage(doc_texts(docs).mapInArrow(encode if lasting else freeing(encode), schema), "pieces")
    # at most capacity x SALTS rows, whatever the corpus
    counts = pieces.groupBy("length", "salt").count().orderBy("length", "salt").collect()
    histogram: dict[int, int] = {}
    offsets = []
    for r in counts:
        offsets.append((r["length"], r["salt"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["count"]
    runs = plan(histogram, capacity)
    first = spark.createDataFrame(offsets, "length long, salt int, before long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("k", F.row_number().over(order))
        .join(F.broadcast(first), ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("k") - 1)
        .drop("k", "before")
    )
    columns = "length long, doc_id long, piece int, start long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in columns.split(", ")]
    placed = ranked.select(*names, "rank", "salt").mapInArrow(_placer(runs), columns + ", sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
