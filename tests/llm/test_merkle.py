"""Fingerprints: equality, likeness, located edits, neighbours."""

import hashlib

from conftest import SF
from llm.odd import TEXTS, documents, empty

from pyspark.sql import functions as F

from tidelog.llm import merkle
from tidelog.llm.queries import op9_merkle_fingerprints


def edited(rows):
    """{doc_id: (n_chars, sha256 of the edited text)} by descending id, then text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        e = t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256").collect()), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = op9_merkle_fingerprints(spark, SF)
    assert found(out) == edited(rows)
    r = out.collect()
    text = dict(rows)
    by_text = {}
    for x in r:
        assert by_text.setdefault(text[x["doc_id"]], x["fingerprint"]) == x["fingerprint"]
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        assert (x["fingerprint"] == x["edited_fingerprint"]) == (hashlib.sha256(text[x["doc_id"]].encode()).hexdigest() == x["edited_sha256"])
    assert len(set(by_text.values())) == len(by_text)
    assert sum(x["near_edited"] for x in r) / len(r) > 0.3 > sum(x["near_next"] for x in r) / len(r)


def test_many_ranges(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expect = edited([tuple(r) for r in docs.collect()])
    for size in (1, 7, 50):  # more than 64 ranges, some, a few
        monkeypatch.setattr(merkle, "RANGE_ROWS", size)
        assert found(merkle.edited_fingerprints(docs)) == expect


def test_odd_documents(spark, monkeypatch):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for size in (2, 2000):
        monkeypatch.setattr(merkle, "RANGE_ROWS", size)
        assert found(merkle.edited_fingerprints(docs)) == edited(rows)
    assert merkle.edited_fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert found(merkle.edited_fingerprints(one)) == edited([(1, "abcdef")])


def test_paragraphs_join_to_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").withColumn("p", merkle.paragraphs(F.col("text")))
    for r in df.collect():
        assert "".join(r["p"]) == r["text"] and all(len(p) <= max(merkle.PARAGRAPH, 1) for p in r["p"])


def test_edits_are_located(spark):
    lines = [f"Paragraph number {i} says something of its own.\n" for i in range(60)]
    other = [*lines]
    other[17], other[40] = "Changed here.\n", "And here.\n"
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    a, b = (merkle.fingerprint(merkle.branches(merkle.leaves(F.col(c)))) for c in "ab")
    r = df.select(a.alias("a"), b.alias("b")).select(merkle.located_edits(F.col("a"), F.col("b")).alias("d"), merkle.located_edits(F.col("a"), F.col("a")).alias("same"), "a", "b").first()
    assert r["d"] == [17, 40] and r["same"] == []
    shared = set(r["a"].split(":")[1].split(",")) & set(r["b"].split(":")[1].split(","))
    assert shared  # sections without an edit keep their node


def test_likeness_is_that_of_the_paragraphs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    part = lambda f: set(f.split(":")[2].split(","))
    for df in (docs, documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])):
        r = sorted(merkle.edited_fingerprints(df).collect(), key=lambda x: -x["doc_id"])
        for x, y in zip(r, [*r[1:], r[0]]):
            for near, other in ((x["near_edited"], x["edited_fingerprint"]), (x["near_next"], y["fingerprint"])):
                a, b = part(x["fingerprint"]), part(other)
                same = x["fingerprint"].split(":")[0] == other.split(":")[0]
                assert near == (1.0 if same else 2.0 * len(a & b) / (len(a) + len(b)))


def test_plan_has_one_exchange_of_texts_and_no_python(spark):
    plan = op9_merkle_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert plan.count("hashpartitioning") == 1 and "SinglePartition" not in plan.replace("SinglePartition, ENSURE", "")
