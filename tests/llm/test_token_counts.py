"""Counts equal the library's; the cache is used and grows by distinct misses."""

import pytest
from conftest import SF, rows
from llm.odd import TEXTS, documents, empty

from tidelog.llm import token_counts
from tidelog.llm.queries import op4_token_counts
from tidelog.llm.tokens import public_path

PATH = public_path("byte_bpe_50k.json")


def expected(docs, path=PATH):
    if path.endswith(".model"):
        import sentencepiece

        n = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(n.encode(t))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    made = []
    for r in docs.select("doc_id", "text").collect():
        s = r["text"] or ""
        made.append((r["doc_id"], len(s.encode()), count(s), count(s) > 1024))
    return sorted(made, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_query(spark):
    assert rows(op4_token_counts(spark, SF)) == expected(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_documents(spark, name):
    docs = documents(spark)
    assert rows(token_counts.count_tokens(docs, public_path(name))) == expected(docs, public_path(name))


def test_cache_keeps_one_entry_for_each_text(spark, tmp_path):
    docs, cache = documents(spark), f"{tmp_path}/cache"
    first = rows(token_counts.count_tokens(docs, PATH, cache))
    stored = spark.read.parquet(cache)
    distinct = len({t for t in [*TEXTS, "a row without an id"] if t})
    assert stored.count() == distinct
    assert rows(token_counts.count_tokens(docs, PATH, cache)) == first
    assert spark.read.parquet(cache).count() == distinct
    token_counts.count_tokens(docs, public_path("word_bpe_49k.json"), cache).count()
    assert spark.read.parquet(cache).count() == 2 * distinct


def test_stored_counts_are_believed(spark, tmp_path):
    import hashlib

    v = token_counts.tokenizer_version(PATH)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), v, 77)], token_counts.CACHE_SCHEMA).write.parquet(f"{tmp_path}/c")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert rows(token_counts.count_tokens(docs, PATH, f"{tmp_path}/c")) == [(1, 1, 77, False)]


def test_no_documents(spark):
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0
