"""Held-out accuracy, rejection and odd rows."""

import numpy as np
import pytest
from conftest import SF
from llm.odd import documents, empty

from tidelog.llm import langid
from tidelog.llm.queries import op2_language_id


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    found = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 1000 and 120 < len(held) < 280
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["rejected"] for r in found]) < 0.01


def test_held_out_is_the_remainder(spark):
    import zlib

    for r in op2_language_id(spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_other_scripts_and_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    texts = ["Привет мир, это совершенно другой текст", "漢字かな交じり文です", None, "", "123 !!! 456", "the and of that with this"]
    got = model.predict(texts)
    assert [g[2] for g in got] == [True, True, True, True, True, False]
    assert [g[0] for g in got[2:5]] == ["und"] * 3 and [g[1] for g in got[2:5]] == [0.0] * 3
    assert got[0][0] in model.langs and got[5][0] == "en"
    assert max(sum(lang == x for x in model.langs) for lang in set(model.langs)) <= langid.CLUSTERS


def test_odd_documents(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    out = langid.predict(docs, model, ("a", "b", "c"))
    assert out.columns == [*docs.columns, "a", "b", "c"] and out.count() == docs.count()
    assert langid.held_out_predictions(docs).count() == docs.count()
    nothing = langid.held_out_predictions(empty(spark))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    unlabelled = langid.fit(docs.where("lang is null"))
    assert {r["p"] for r in langid.predict(docs, unlabelled, ("p", "s", "r")).collect()} == {"und"}


def test_counts_do_not_depend_on_the_batch():
    texts = ["ab c", "", "Éa", "x" * 10, "a b a b", None]
    together = langid.counts([t or "" for t in texts])
    assert all((together[i] == langid.counts([t or ""])[0]).all() for i, t in enumerate(texts))
    assert together[0].sum() == 5 + 3  # bigrams _a ab b_ _c c_; trigrams _ab... around each letter


def test_long_texts_are_counted_whole(monkeypatch):
    texts = ["the quick brown fox " * 200, "ΟΔΥΣΣΕΥΣ İstanbul ß " * 90, "x" * 3000, "1 2 " * 500, " a" * 900]
    whole = langid.counts(texts)
    for piece in (1, 2, 3, 777, 4000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.counts(texts) == whole).all()
        assert all((langid.counts([t])[0] == w).all() for t, w in zip(texts, whole))


def test_counts_equal_a_plain_count():
    for text in ("Hello, big world", "ab  cd e", "ΟΔΟΣ", "x"):
        c = [x if x.isalpha() else " " for x in " " + text.lower() + "  "]
        grams = [(c[i], c[i + 1]) for i in range(len(c) - 2) if c[i : i + 2] != [" ", " "]]
        threes = [i for i in range(len(c) - 2) if c[i + 1] != " "]
        assert langid.counts([text])[0].sum() == len(grams) + len(threes)


def test_rows_that_share_an_id_or_have_none(spark):
    """The sample is bounded by rows, and rows without an id are learned from."""
    made = [(None if i % 2 else 7, f"{'the of and' if lang == 'en' else 'der die und'} {i} words{i}", lang) for i in range(600) for lang in ("en", "de")]
    made += [(7, "the same row again and again", "en")] * 500
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4)
    seen = spark.sparkContext.accumulator(0)
    plain = langid._cluster_of

    def counted(idf):
        run = plain(idf)

        def count(group):
            seen.add(len(group))
            return run(group)

        return count

    langid._cluster_of = counted
    try:
        model = langid.fit(docs, sample=50)
    finally:
        langid._cluster_of = plain
    assert 60 <= seen.value <= 100  # at most 50 of each language
    assert [g[0] for g in model.predict(["the and of words", "und der die words"])] == ["en", "de"]
    alone = langid.fit(spark.createDataFrame([(7, "one single row, many times over", "en")] * 3000, "doc_id long, text string, lang string"), sample=5)
    assert alone.langs == ["en"]


def test_query_predicts_the_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(langid.remainder("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in op2_language_id(spark, SF).collect()}
    for r in docs.collect():
        x = langid.weighted(langid.counts([r["text"]]), model.idf)[0]
        near = [sum(float(a) * float(b) for a, b in zip(x[x > 0], c[x > 0])) for c in model.centroids]
        best = max(near)
        assert abs(got[r["doc_id"]]["score"] - best) < 1e-4
        assert any(abs(n - best) < 1e-5 and lang == got[r["doc_id"]]["lang_pred"] for n, lang in zip(near, model.langs))


def foreign_and_noise():
    """Latin-script texts that are none of the languages: two real languages, random letters, base64."""
    import base64

    rng = np.random.default_rng(4)
    letters = ["".join(map(chr, rng.integers(97, 123, 400))) for _ in range(20)]
    words = [" ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(60)) for _ in range(20)]
    coded = [base64.b64encode(rng.bytes(300)).decode() for _ in range(20)]
    fi = "Tämä on suomenkielinen lause, jossa kerrotaan talvesta ja pitkistä öistä pohjoisessa maassa."
    tr = "Bu sabah pazara gittim ve arkadaşlarımla birlikte taze sebze ve meyve aldım, sonra eve döndüm."
    return [*letters, *words, *coded, fi, tr]


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_noise_and_foreign_languages_are_rejected_at_all_sizes(spark, sf):
    docs = spark.read.parquet(f"{SF.replace('0.001', sf)}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    assert all(g[2] for g in model.predict(foreign_and_noise()))
    known = model.predict([r["text"] for r in docs.limit(1000).collect()])
    assert np.mean([g[2] for g in known]) < 0.02
