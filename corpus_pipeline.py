"""From raw documents to packed training sequences, in four stages.

Each stage reads its predecessor's Parquet and returns a DataFrame; all but the last
return the columns of ``documents``. Decisions take effect: documents that language
identification rejects, all but one of each near-duplicate group, and documents that
hold benchmark items are gone from what follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid, packing, shingles, tiling
from tidelog.llm.store import Workspace, free_name
from tidelog.llm.tokens import public_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that nearest-centroid classification rejects."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    named = tuple(free_name(n, docs.columns) for n in ("lang_pred", "score", "rejected"))
    return langid.predict(docs, model, named).where(~F.col(named[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group at five-word similarity 0.8."""
    return shingles.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return tiling.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents with their sequences."""
    return packing.pack(docs, public_path("word_bpe_49k.json"), lasting=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenizing, fingerprints and tiling have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.stage(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
