"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

ROUNDS, SALTS = 60, 4


def _sum(df: DataFrame):
    """Order-free digest of an edge table."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang each node's larger neighbours on its least one; small star: the others."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a node with very many neighbours is spread over salts, which adaptive skew joins can split further
    salts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))
    hung = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(least.withColumn("s", salts), ["u", "s"])
    if large:
        hung = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame, ws: Workspace, name: str = "star") -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge.

    Each round is staged, so lineage stays one round long; self links and repeats are
    dropped. Stops when a round changes nothing."""
    now = ws.stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before = _sum(now)
    for k in range(1, ROUNDS):
        if not before[0]:
            break
        now = ws.stage(_star(_star(now, True), False), f"{name}-{k}")
        after = _sum(now)
        ws.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
