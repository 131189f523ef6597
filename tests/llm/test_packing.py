"""Runs of bins equal item-by-item best fit; pieces fill sequences without gaps."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import documents, empty

from tidelog.llm import packing
from tidelog.llm.queries import op10_best_fit_packing
from tidelog.llm.tokens import encoder, public_path

PATH = public_path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """How full the bins are, each item put into the fullest bin that takes it (ties: any)."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        (max(fits, key=sum) if fits else bins.append([]) or bins[-1]).append(n)
    return sorted(map(sum, bins))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_equals_best_fit(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = defaultdict(list)
    for length, _, items, first, each, offset in packing.plan(histogram, 30):
        for k in range(items):
            bins[first + k // each].append((offset + k % each * length, length))
    for b in bins.values():  # gapless from 0
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 30
    assert sorted(sum(n for _, n in b) for b in bins.values()) == best_fit(lengths, 30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=25), st.integers(0, 40))
def test_tree_finds_the_tightest_room(rooms, need):
    tree = packing.RoomTree(40)
    for r in rooms:
        tree.add(r, 1)
    assert tree.tightest(need) == min((r for r in rooms if r >= need), default=None)


def expected(rows, capacity=4096):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(PATH), []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check(df, rows, capacity=4096):
    found = df.collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == expected(rows, capacity)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == len(best_fit([r["length"] for r in found], capacity))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(op10_best_fit_packing(spark, SF), rows)


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for capacity in (7, 100, 4096):
        check(packing.pack(docs, PATH, capacity), rows, capacity)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_ids_come_along(spark):
    out = packing.pack(documents(spark), PATH, 64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)


def test_pieces_of_a_long_text_need_no_object_for_each_pretoken():
    text = "the cat's 12 -- of a house\n" * 200_000
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    run = packing._pieces(PATH, 4096, 1, False)
    first = list(run([batch]))
    tracemalloc.start()
    again = list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)
    assert first == again and sum(again[0].column("length").to_pylist()) == len(encoder(PATH)._whole([text])[0]) // 4 + 1
