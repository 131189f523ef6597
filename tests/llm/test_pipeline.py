"""The stages and their order, each against what it should keep."""

import corpus_pipeline
from conftest import SF
from llm.odd import documents, empty
from llm.test_packing import check
from llm.test_shingles import kept as one_of_each_group

from tidelog.llm import langid, tiling


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def kept(spark, docs, sf):
    """Rows (doc_id, text) that the three filters should leave, by plain Python."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, p in zip(rows, model.predict([t for _, t in rows])) if not p[2]]
    lowest = set(one_of_each_group(rows))
    rows = sorted({r for r in rows if r[0] in lowest})
    space = lambda t: " " + " ".join(tiling.words_of(t)) + " "
    items = [space(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return [r for r in rows if not any(i in space(r[1]) for i in items)]


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expect = kept(spark, docs, SF)
    assert 150 < len(expect) < 200
    check(corpus_pipeline.run(spark, SF), expect)


def test_filters_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() > 0.9 * docs.count()


def test_odd_and_empty_documents(spark):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            out.count()


def test_no_worker_keeps_a_tokenizer_after_the_stages(spark):
    def held(batches):
        import os
        import time

        import pyarrow as pa

        from tidelog.llm import tokens

        list(batches)
        time.sleep(0.2)  # so that all workers take part
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(tokens._ENCODERS)])], names=["pid", "n"])

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
    found = spark.range(0, 32, 1, 32).mapInArrow(held, "pid long, n long").collect()
    assert len({r["pid"] for r in found}) > 1 and not any(r["n"] for r in found)
