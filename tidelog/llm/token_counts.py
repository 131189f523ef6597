"""Token counts through a digest cache.

A stored table maps (content digest, tokenizer-version digest) to a token count. A run
joins the documents' digests to it, encodes one text of each digest that is not there,
and appends the new counts. Counts depend on nothing but content and tokenizer.

Defined results: null text counts as empty (0 tokens, no cache entry needed); equal
texts share an entry; every input row gives a row, repeated or null ids included;
extra columns are ignored; an empty table gives an empty result.

Scale: texts move in one shuffle, after each map task has dropped its own repeated
digests, so a digest that holds a third of all rows arrives once per map task. The
last join carries ids and digests only and is left to adaptive skew handling.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace, doc_texts, rows

LIMIT = 1024
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """Content as the cache sees it. Null is empty; no other change, because byte-level
    tokenizers count case, accents and white space differently."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the encoding rules used here."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"whole text, no special tokens added").hexdigest()


def _counter(path: str):
    """Counts the tokens of one text of each digest."""

    def run(batches):
        import pyarrow as pa

        for b in rows(batches):
            digests, texts = b.column("digest"), b.column("text").to_pylist()
            if path.endswith(".model"):
                import sentencepiece

                n = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
            else:
                from .tokens import encoder

                n = [len(x) // 4 for x in encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache_dir: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``cache_dir`` keeps counts between runs."""
    spark = docs.sparkSession
    ws = Workspace(spark, "token-counts")
    cache_dir = cache_dir or ws.path("cache")
    version = tokenizer_version(path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    texts = doc_texts(docs).select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version)
    misses = texts.where(F.col("text") != "").groupBy("digest").agg(F.first("text").alias("text")).join(stored.select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(_counter(path), "digest binary, n_tokens long").select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").parquet(cache_dir)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version)
    # a job that ran twice may have appended an entry twice: equal counts, one is kept
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # two salts: a digest of very many documents meets in two tasks, which adaptive skew joins split further
    counts = counts.withColumn("salt", F.explode(F.array(F.lit(0), F.lit(1))))
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    return (
        texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("salt"))
        .join(counts, ["digest", "salt"], "left")
        .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
    )
