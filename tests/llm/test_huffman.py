"""Code book, block coding, and files read back."""

import zlib

import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import documents, empty

from tidelog.llm import huffman
from tidelog.llm.queries import op1_huffman_ids
from tidelog.llm.tokens import public_path

PATH = public_path("byte_bpe_50k.json")


def optimal(counts, limit):
    """Least cost by dynamic programming over lengths (counts descending, lengths ascending)."""
    import functools

    c = sorted((x for x in counts if x), reverse=True)
    n = len(c)

    @functools.cache
    def best(i, length, slots):
        if i == n:
            return 0
        if length > limit or slots <= 0:
            return float("inf")
        out, cost = best(i, length + 1, slots * 2), 0
        for k in range(1, min(slots, n - i) + 1):
            cost += c[i + k - 1] * length
            out = min(out, cost + best(i + k, length + 1, (slots - k) * 2))
        return out

    return best(0, 1, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=2, max_size=9), st.integers(4, 6))
def test_lengths_are_optimal_and_limited(counts, limit):
    c = np.array(counts)
    if (c > 0).sum() < 2:
        return
    bits = huffman.code_lengths(c, limit)
    assert bits.max() <= limit and ((bits > 0) == (c > 0)).all()
    assert sum(2.0 ** -bits[bits > 0]) <= 1
    assert (bits * c).sum() == optimal(tuple(counts), limit)


def test_codes_are_canonical_and_prefix_free():
    bits = huffman.code_lengths(np.array([5, 1, 1, 9, 0, 2]))
    codes = huffman.canonical(bits)
    text = {i: format(codes[i], f"0{bits[i]}b") for i in np.flatnonzero(bits)}
    assert all(not b.startswith(a) for i, a in text.items() for j, b in text.items() if i != j)
    order = sorted(text, key=lambda i: (bits[i], i))
    assert [int(text[i].ljust(18, "0"), 2) for i in order] == sorted(int(text[i].ljust(18, "0"), 2) for i in order)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=8), st.integers(0, 5), st.sampled_from([1, 2, 40, 3000]))
def test_blocks_round_trip(sizes, seed, symbols):
    sizes = np.array(sizes)
    ids = np.random.default_rng(seed).zipf(1.4, sizes.sum()) % symbols
    bits = huffman.code_lengths(np.bincount(ids, minlength=symbols))
    payload, at, marks = huffman.encode(ids, sizes, bits, huffman.canonical(bits))
    back = huffman.decode(payload, at, sizes, marks.astype(np.int64), huffman.decoding_table(bits))
    assert (back == ids).all()


def expected(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = op1_huffman_ids(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected(rows)


def test_odd_documents_in_small_blocks(spark, tmp_path):
    docs = documents(spark)
    huffman.write_ids(docs, PATH, f"{tmp_path}/ids", block_ids=50)
    found = huffman.read_ids(spark, f"{tmp_path}/ids", with_ids=True).orderBy("start").collect()
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(((r[0] or -1, r[2], r[3]) for r in found)) == sorted(((r[0] or -1, r[2], r[3]) for r in expected(rows)))
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in rows]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)


def test_no_documents(spark, tmp_path):
    huffman.write_ids(empty(spark), PATH, f"{tmp_path}/none")
    assert huffman.read_ids(spark, f"{tmp_path}/none").count() == 0
