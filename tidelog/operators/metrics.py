"""Counters, gauges, exact latency quantiles, reports and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import dense_rank_of_rows, order_statistics, position_bucket
from ..functions.rules import RING_SLOTS, quantiles

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def exact_sum(c: str) -> Column:
    """Sum to six decimal places, the same in any order of addition."""
    return F.sum(F.col(c).cast("decimal(20,6)")).cast("double")


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(exact_sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """The last value set for each name."""
    return samples.groupBy("name").agg(F.max_by("value", "pos").alias("value"))


def histograms(samples: DataFrame) -> DataFrame:
    """name, count, sum, p50, p95, p99 over all observations, the quantiles exact."""
    summed = samples.groupBy("name").agg(F.count(F.lit(1)).alias("count"), exact_sum("value").alias("sum"))
    ranked = order_statistics(samples, ["name"], "value", QUANTILES).withColumnRenamed("name", "of")
    return summed.join(ranked, F.col("name").eqNullSafe(F.col("of")), "left").select("name", "count", "sum", *QUANTILES)


def ring(samples: DataFrame, slots: int = RING_SLOTS) -> DataFrame:
    """One row: count and sum of all observations, quantiles of the last one in each slot
    (as many values as there are slots).

    Observation i fills slot i-1 up to the number of slots, then slot i mod slots."""
    numbered = dense_rank_of_rows(samples.select("pos", "value"), ["pos"], position_bucket("pos"), "i")
    slot = F.when(F.col("i") <= slots, F.col("i") - 1).otherwise(F.col("i") % slots)
    kept = numbered.groupBy(slot.alias("slot")).agg(F.max_by("value", "i").alias("value")).agg(*quantiles("value", QUANTILES))
    return samples.agg(F.count(F.lit(1)).alias("count"), exact_sum("value").alias("sum")).join(F.broadcast(kept))


def workload_report(samples: DataFrame, seconds: float) -> DataFrame:
    """One row from (op, ok, latency): operations, reads, writes, rate, error rate, quantiles."""
    n = F.count(F.lit(1))
    ranked = order_statistics(samples, [], "latency", QUANTILES)  # one row
    summed = samples.agg(
        n.alias("operations"),
        F.count_if(F.col("op") == "GET").alias("reads"),
        F.count_if(F.col("op") != "GET").alias("writes"),
        (n / F.lit(float(seconds))).alias("operations_per_second"),
        F.coalesce(F.try_divide(F.count_if(~F.col("ok")).cast("double"), n.cast("double")), F.lit(0.0)).alias("error_rate"),
        F.max("latency").alias("max"),
    )
    return summed.join(F.broadcast(ranked)).select(*[c for c in summed.columns if c != "max"], *QUANTILES, "max")


def prometheus(counters: DataFrame, gauges: DataFrame, histogram: DataFrame) -> DataFrame:
    """section, name, line_no, line: counters, gauges, then for each histogram its count, sum
    and quantiles; ordered by section, name and line_no it is the exposition text."""
    num = lambda c: F.col(c).cast("decimal(20,6)").cast("string")
    plain = lambda df, k: df.select(F.lit(k).alias("section"), "name", F.lit(0).alias("line_no"), F.concat_ws(" ", "name", num("value")).alias("line"))
    lines = [F.concat(F.col("name"), F.lit("_count "), F.col("count").cast("string")), F.concat(F.col("name"), F.lit("_sum "), num("sum"))]
    lines += [F.concat(F.col("name"), F.lit(f'{{quantile="{q}"}} '), num(c)) for c, q in QUANTILES.items()]
    rows = histogram.select(F.lit(2).alias("section"), "name", F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return plain(counters, 0).unionByName(plain(gauges, 1)).unionByName(rows)


def json_lines(events: DataFrame, fields: list[str], level: str | Column = "INFO") -> DataFrame:
    """One JSON object for each event: timestamp, level, event, fields in order."""
    level = F.lit(level) if isinstance(level, str) else level
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(F.to_json(F.struct(stamp.alias("timestamp"), level.alias("level"), "event", *fields)).alias("line"))
