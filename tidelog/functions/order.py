"""Global order without a global partition: ranks, running totals and neighbours over buckets.

A bucket is any expression that never decreases along the order and holds a bounded
number of rows. Ranks and totals are computed within buckets; what came before a bucket
is a prefix sum over one row for each bucket, joined back. A bucket is never null: a null
order value comes first, in a bucket of its own, and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bucket of a dense integer order.
WIDTH = 1 << 20
#: Ranges of a sampled order, and sampled values for each.
RANGES, PER_RANGE = 256, 16


def position_bucket(pos: str | Column, width: int = WIDTH) -> Column:
    """Bucket of an integer position: at most ``width`` rows if positions are unique; nulls first."""
    found = F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(width)).cast("long")
    return F.coalesce(found, F.lit(-(2**63)).cast("long"))


def range_bounds(df: DataFrame, column: str, ranges: int = RANGES) -> list:
    """Sorted values that cut a column into ranges alike in size: a sample of fixed size, by
    hash. Any bounds give right results; these only balance the ranges."""
    found = df.select(column).distinct().where(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(ranges * PER_RANGE)
    values = sorted(r[0] for r in found.collect())
    return values[PER_RANGE::PER_RANGE]


def range_bucket(column: str | Column, bounds: list) -> Column:
    """How many of the sorted bounds lie at or below a value (null: before all)."""
    c = F.col(column) if isinstance(column, str) else column
    if not bounds:
        return F.when(c.isNull(), -1).otherwise(0)
    table = F.array(*[F.lit(b) for b in bounds])
    return F.when(c.isNull(), -1).otherwise(F.size(F.filter(table, lambda b: b <= c)))


def _joined(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what was found for their keys, nulls equal to nulls."""
    renamed = found.withColumnsRenamed({k: f"{k}__f" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}__f")) for k in keys]
    return rows.join(renamed, on).drop(*(f"{k}__f" for k in keys))


def running_totals(df: DataFrame, values: dict[str, str | Column], order: list, bucket: Column) -> DataFrame:
    """Adds, for each name, the sum of its value over all rows up to and including each, in the
    given order. One shuffle by bucket, whatever the number of sums."""
    rows = df.withColumn("__bucket", bucket).withColumns({f"__{n}": F.col(v) if isinstance(v, str) else v for n, v in values.items()})
    sums = rows.groupBy("__bucket").agg(*(F.sum(f"__{n}").alias(f"__sum_{n}") for n in values))
    # one row for each bucket: small against the rows, though not bounded
    w = Window.orderBy("__bucket")
    before = sums.select("__bucket", *((F.sum(f"__sum_{n}").over(w) - F.col(f"__sum_{n}")).alias(f"__before_{n}") for n in values))
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumns({f"__inside_{n}": F.sum(f"__{n}").over(inside) for n in values})
        .join(before, "__bucket")
        .withColumns({n: F.col(f"__inside_{n}") + F.col(f"__before_{n}") for n in values})
        .drop("__bucket", *(f"__{k}{n}" for n in values for k in ("", "inside_", "before_")))
    )


def running_total(df: DataFrame, value: str | Column, order: list, bucket: Column, name: str) -> DataFrame:
    """Adds one running sum."""
    return running_totals(df, {name: value}, order, bucket)


def dense_rank_of_rows(df: DataFrame, order: list, bucket: Column, name: str, start: int = 1) -> DataFrame:
    """Adds the number of each row in the order, from ``start``."""
    ranked = running_total(df, F.lit(1).cast("long"), order, bucket, name)
    return ranked if start == 1 else ranked.withColumn(name, F.col(name) + F.lit(start - 1))


def _neighbour(df: DataFrame, column: str, name: str, keys: list[str], order: list[str], bucket: Column, ahead: bool) -> DataFrame:
    near, pick = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    rows = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ends = rows.groupBy(*keys, "__bucket").agg(pick(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__end"))
    # one row for each key and bucket
    carried = ends.select(*keys, "__bucket", near("__end").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__carried"))
    placed = rows.withColumn("__edge", near(F.lit(1)).over(inside).isNull()).withColumn("__near", near(column).over(inside))
    found = placed.join(carried, [*keys, "__bucket"], "left")
    return found.withColumn(name, F.when(F.col("__edge"), F.col("__carried.v")).otherwise(F.col("__near"))).drop("__bucket", "__edge", "__near", "__carried")


def previous_in_key(df: DataFrame, column: str, name: str, key: str = "key", pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Adds the column's value in the key's row before this one (null: none).

    A key's rows are dealt by position bucket, so one key may hold any share of the rows:
    the first row of a bucket takes the last value of the key's bucket before, which comes
    from one row for each key and bucket."""
    return _neighbour(df, column, name, [key], [pos], position_bucket(pos, width), False)


def next_in_key(df: DataFrame, column: str, name: str, key: str = "key", pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Adds the column's value in the key's row after this one (null: none)."""
    return _neighbour(df, column, name, [key], [pos], position_bucket(pos, width), True)


def previous_in_order(df: DataFrame, column: str, name: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds the column's value in the row before this one in a global order (null: none)."""
    return _neighbour(df, column, name, [], order, bucket, False)


def order_statistics(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles of a column for each group, by linear interpolation between order
    statistics. Equal values are counted before the shuffle; running counts are taken in
    value ranges, so no task holds a group's values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    cuts = [i / RANGES for i in range(1, RANGES)]
    bounds = df.agg(F.percentile_approx(value, cuts, 10_000).alias("__cuts"))  # one row; any cuts give right results
    place = F.size(F.filter("__cuts", lambda b: b < F.col("__v")))
    rows = counted.join(F.broadcast(bounds)).withColumn("__b", place).drop("__cuts")
    sums = rows.groupBy(*by, "__b").agg(F.sum("__c").alias("__s"))  # RANGES rows for each group at most
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = sums.select(*by, "__b", (F.sum("__s").over(whole.orderBy("__b")) - F.col("__s")).alias("__before"), F.sum("__s").over(whole).alias("__n"))
    inside = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = _joined(rows.withColumn("__in", F.sum("__c").over(inside)), before, [*by, "__b"]).withColumn("__upto", F.col("__in") + F.col("__before"))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__c") <= index) & (index < F.col("__upto")), F.col("__v")))

    parts = {}
    for name, q in quantiles.items():
        spot = F.lit(q) * (F.col("__n") - 1)
        parts |= {f"__lo_{name}": at(F.floor(spot)), f"__hi_{name}": at(F.ceil(spot)), f"__at_{name}": F.max(spot)}
    found = upto.groupBy(*by).agg(*(c.alias(n) for n, c in parts.items()))

    def mixed(name: str) -> Column:
        lo, hi, spot = (F.col(f"__{k}_{name}") for k in ("lo", "hi", "at"))
        return F.when(lo == hi, lo).otherwise((F.ceil(spot) - spot) * lo + (spot - F.floor(spot)) * hi).cast("double").alias(name)

    return found.select(*by, *(mixed(n) for n in quantiles))
