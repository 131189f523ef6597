"""Token ids as canonical length-limited Huffman blocks.

Counts of all ids give one code book (package-merge, codes of at most ``MAX_BITS``
bits, canonical: ordered by length, then id). A block is self-contained: ids of whole
documents in ascending doc_id order, each starting on a byte; a bit offset for every
``EVERY``-th id of a document; sizes. A reader decodes all checkpoints of a block side
by side with one table of 2^MAX_BITS entries, or a single document from its offset.

Layout below the output folder: ``codebook`` (id, bits) and ``blocks`` with one row per
block, committed by Spark's own protocol, so a lost executor leaves no half block.
Within a part (one writing task, a doc_id range) blocks are numbered; parts ascend.

Defined results: null or empty text is the end id alone; documents with a null id come
first; repeated ids keep one entry each; an empty table gives no blocks and no rows.

Scale: one tokenizing pass stages compressed ids and per-task counts; coding is a map;
only coded bytes are shuffled, once, by doc_id range. Range bounds come from quantiles
of the id column; starts come from totals per part and a window within each part.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, doc_texts, range_number, rows

MAX_BITS, EVERY, BLOCK_IDS, END_ID = 18, 128, 1 << 20, 0
BLOCKS = "part int, block long, before long, n_docs long, n_ids long, doc_ids array<long>, doc_sizes array<long>, byte_offsets array<long>, checkpoints binary, payload binary"
STAGED = "doc_id long, n_ids long, ids binary, counts binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge), 0 where a count is 0."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, levels, packages = len(order), [], np.empty(0)
    for _ in range(limit):  # each level: the leaves merged with the pairs of the level before
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for leaf in reversed(levels):  # of the cheapest items taken, leaves gain a bit, packages open the level before
        leaves = int(leaf[:take].sum())
        bits[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code of each symbol, ordered by length and then symbol."""
    codes, code, last = np.zeros(len(bits), np.int64), 0, 0
    for length in range(1, int(bits.max(initial=0)) + 1):
        code <<= length - last
        last = length
        at = np.flatnonzero(bits == length)
        codes[at] = code + np.arange(len(at))
        code += len(at)
    return codes


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbol and length (symbol << 5 | length) for every prefix of as many bits as the longest code has."""
    width = int(bits.max(initial=1))
    table = np.ones(1 << width, np.int64)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (width - bits[order])
    filled = int(spans.sum())
    table[:filled] = np.repeat(order << 5 | bits[order], spans)
    return table, width


def encode(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, codes: np.ndarray):
    """Codes documents, each from a byte on: payload, byte offset of each, bit offset of
    every EVERY-th id from its document's start."""
    both = ((codes << 5) | bits)[ids]  # one look-up for code and length
    length = both & 31
    upto = np.cumsum(length)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], upto])[np.append(starts, len(ids))]  # bits ahead of each document without padding
    size = (np.diff(before) + 7) // 8
    offsets = np.cumsum(size) - size
    at = upto - length + np.repeat(offsets * 8 - before[:-1], sizes)
    words = np.zeros(int(size.sum()) // 4 + 3, np.uint32)
    if len(ids):
        value = (both >> 5).view(np.uint64) << (64 - (at & 31) - length).view(np.uint64)
        word = at >> 5
        # the codes that start in a 32-bit word follow each other; only the last may reach the next word
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        last = np.append(first[1:], len(word)) - 1
        words[word[first]] = np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
        words[word[last] + 1] |= value[last].astype(np.uint32)
    payload = words.astype(">u4").tobytes()[: int(size.sum())]
    n_marks = -(-sizes // EVERY)
    nth = np.arange(int(n_marks.sum())) - np.repeat(np.cumsum(n_marks) - n_marks, n_marks)
    marks = (at[np.repeat(starts, n_marks) + nth * EVERY] - np.repeat(offsets * 8, n_marks)).astype("<u4")
    return payload, offsets, marks


def decode(payload: bytes, byte_offsets: np.ndarray, sizes: np.ndarray, marks: np.ndarray, table) -> np.ndarray:
    """All ids of a block: the stretches between checkpoints are decoded side by side."""
    entries, width = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    n_marks = -(-sizes // EVERY)
    nth = np.arange(int(n_marks.sum())) - np.repeat(np.cumsum(n_marks) - n_marks, n_marks)
    todo = np.minimum(np.repeat(sizes, n_marks) - nth * EVERY, EVERY)
    target = np.repeat(np.cumsum(sizes) - sizes, n_marks) + nth * EVERY
    position = np.repeat(byte_offsets * 8, n_marks) + marks
    order = np.argsort(-todo, kind="stable")
    todo, target, position = todo[order], target[order], position[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    active = np.searchsorted(-todo, -np.arange(int(todo.max(initial=0))), "left")
    right = np.uint32(32 - width)
    for step, n in enumerate(active.tolist()):
        p = position[:n]
        prefix = (window[p >> 3] << (p & 7).astype(np.uint32)) >> right
        found = entries[prefix]
        out[target[:n] + step] = found >> 5
        p += found & 31
    return out


def _tokenized(path: str, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc = encoder(path)
        kind = np.uint16 if enc.vocab <= 1 << 16 else np.uint32
        counts = np.zeros(max(enc.vocab, end_id + 1), np.int64)

        def batch(docs, sizes, data, count):
            arrays = [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), pa.array(count, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids", "counts"])

        for b in rows(batches, 1024):
            data = [x + end for x in enc.encode(b.column("text").to_pylist())]
            ids = np.frombuffer(b"".join(data), np.uint32)
            counts += np.bincount(ids, minlength=len(counts))
            ends = np.cumsum([0, *(len(x) // 4 for x in data)])
            small, at = ids.astype(kind).tobytes(), (ends * np.dtype(kind).itemsize).tolist()
            yield batch(b.column("doc_id").to_pylist(), np.diff(ends), [small[a:z] for a, z in zip(at, at[1:])], [None] * len(data))
        if counts.any():
            yield batch([None], [0], [None], [counts.tobytes()])

    return run


def _count_rows(batches):
    import pyarrow as pa

    total = None
    for b in batches:
        for x in b.column("counts").to_pylist():
            c = np.frombuffer(x, np.int64)
            total = c.copy() if total is None else total + c
    if total is not None:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])


def _coded(bits: np.ndarray, codes: np.ndarray, ids_kind: str):
    """Codes each document by itself; blocks are put together from whole bytes later."""

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for b in rows([big], 2048, 4_000_000, "ids"):
                sizes = b.column("n_ids").to_numpy()
                payload, offsets, marks = encode(np.frombuffer(b"".join(b.column("ids").to_pylist()), ids_kind), sizes, bits, codes)
                at = [*offsets.tolist(), len(payload)]
                to = np.cumsum([0, *(-(-sizes // EVERY) * 4)]).tolist()
                marks = marks.tobytes()
                cut = lambda data, x: pa.array([data[a:z] for a, z in zip(x, x[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_ids"), cut(payload, at), cut(marks, to)], names=["doc_id", "n_ids", "payload", "checkpoints"])

    return run


def _assembled(block_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
        docs, sizes, payload, marks = [], [], [], []

        def block():
            nonlocal number, before
            at = np.cumsum([0, *map(len, payload)])[:-1]
            row = [part, number, before, len(docs), sum(sizes), docs.copy(), sizes.copy(), at, b"".join(marks), b"".join(payload)]
            number, before = number + 1, before + sum(sizes)
            for x in (docs, sizes, payload, marks):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        held = 0
        for b in batches:
            for d, n, p, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_ids", "payload", "checkpoints"))):
                if docs and held + n > block_ids:
                    yield block()
                    held = 0
                docs.append(d)
                sizes.append(n)
                payload.append(p)
                marks.append(m)
                held += n
        if docs:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every document and writes code book and blocks below ``out``."""
    spark = docs.sparkSession
    ws = Workspace(spark, "huffman")
    staged = ws.stage(doc_texts(docs).mapInArrow(_tokenized(path, end_id), STAGED), "ids")
    counted = staged.where(F.col("counts").isNotNull()).select("counts").mapInArrow(_count_rows, "id long, n long")
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has ids
    size = max((r["id"] for r in found), default=0) + 1
    counts = np.zeros(size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    bits = code_lengths(counts)
    codes = canonical(bits)
    book = [(int(i), int(bits[i])) for i in np.flatnonzero(bits)]
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{out}/codebook")

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts or [0.5], 100_000)).first()[0] or []
    bounds = sorted(set(bounds)) if cuts else []
    from .tokens import encoder

    kind = "<u2" if encoder(path).vocab <= 1 << 16 else "<u4"
    part = range_number(F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")), bounds)
    ids = staged.where(F.col("ids").isNotNull()).select("doc_id", "n_ids", "ids")
    (
        ids.mapInArrow(_coded(bits, codes, kind), "doc_id long, n_ids long, payload binary, checkpoints binary")
        .repartitionById(len(bounds) + 1, part.cast("int"))
        .sortWithinPartitions("doc_id", "n_ids", "payload")
        .mapInArrow(_assembled(block_ids), BLOCKS)
        .write.mode("overwrite")
        .option("compression", "none")
        .parquet(f"{out}/blocks")
    )
    ws.drop("ids")


def _reader(book: list[tuple[int, int]], with_ids: bool):
    def run(batches):
        import pyarrow as pa

        bits = np.zeros(max((i for i, _ in book), default=0) + 1, np.int64)
        for i, n in book:
            bits[i] = n
        table = decoding_table(bits)
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                sizes, at = (np.array(row[c].as_py(), np.int64) for c in ("doc_sizes", "byte_offsets"))
                ids = decode(row["payload"].as_py(), at, sizes, np.frombuffer(row["checkpoints"].as_py(), "<u4").astype(np.int64), table)
                ends = np.cumsum(sizes)
                view = memoryview(ids.tobytes())
                spans = [(4 * int(a), 4 * int(z)) for a, z in zip(ends - sizes, ends)]
                first = row["before"].as_py()
                arrays = [
                    pa.array(row["doc_ids"].as_py(), pa.int64()),
                    pa.array(first + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(view[a:z]) for a, z in spans], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([bytes(view[a:z]) for a, z in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def read_ids(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32 (and ids as bytes)."""
    book = [(r["id"], r["bits"]) for r in spark.read.parquet(f"{out}/codebook").collect()]  # vocabulary-sized
    blocks = spark.read.parquet(f"{out}/blocks")
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row for each writing task
    ahead = by_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("ahead"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    columns = ["doc_ids", "doc_sizes", "byte_offsets", "checkpoints", "payload"]
    before = (F.col("ahead") + F.col("before")).alias("before")
    return blocks.join(F.broadcast(ahead), "part").select(*columns, before).mapInArrow(_reader(book, with_ids), schema)
