"""Scratch tables in the shared folder, and small helpers every operator uses.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` and read
back: that cuts lineage and survives lost executors. Nothing here touches a
machine-local folder unless Spark itself runs in local mode without that setting.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        root = tempfile.mkdtemp(prefix="tidelog-")
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """A folder of scratch tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "snappy", mode: str = "overwrite") -> DataFrame:
        schema = df.schema
        df.write.mode(mode).option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty), and the named columns; no other column."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def rows(batches: Iterator, size: int = 512, chars: int = 8_000_000, text: str = "text") -> Iterator:
    """Record batches cut to a bounded number of rows and bytes of the text column."""
    import pyarrow.compute as pc

    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        while at < n:
            end, total = at + 1, sizes[at]
            while end < n and end - at < size and total + sizes[end] <= chars:
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def range_number(column: Column, bounds: list[int]) -> Column:
    """How many of some sorted bounds lie below an id: 64 at a time, then within those 64."""
    numbers = lambda x: F.array(*[F.lit(b).cast("long") for b in x]) if x else F.expr("cast(array() as array<bigint>)")
    below = lambda x: F.size(F.filter(x, lambda b: b < column))
    if len(bounds) <= 64:
        return below(numbers(bounds))
    table = F.array(*[numbers(bounds[i : i + 64]) for i in range(0, len(bounds), 64)])
    coarse = below(numbers(bounds[63::64]))
    return coarse * 64 + below(F.coalesce(F.get(table, coarse), numbers([])))


def remainder(column: str, n: int):
    """crc32 of the decimal text of an id (null: of the empty text) modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
