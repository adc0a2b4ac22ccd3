"""Dense row numbers in a stated order, without gathering the rows in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _place_among(value: Column, limits: list) -> Column:
    """How many of the sorted limits are at or below the value: first among every n-th limit, then among the n after it."""
    if not limits:
        return F.lit(0)
    step = max(math.isqrt(len(limits)), 1)
    groups = [limits[i : i + step] for i in range(0, len(limits), step)]

    def at_or_below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= value))

    group = at_or_below(F.array(*[F.lit(g[0]) for g in groups])) - 1
    inside = F.get(F.array(*[F.array(*[F.lit(v) for v in g]) for g in groups]), group)
    return F.when(group < 0, F.lit(0)).when(value.isNull(), F.lit(0)).otherwise(group * step + at_or_below(inside))


def dense_index(df: DataFrame, key: str, out: str = "index", start: int = 0, n_ranges: int | None = None) -> DataFrame:
    """Number rows ``start``, ``start + 1``, ... in the order of the unique column ``key``.

    Range limits come from a small sample of keys and then are literals of the plan, so they stay the same however
    often a task runs again. Rows are numbered inside each range and shifted by the sizes of the ranges before it.
    """
    spark = df.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # hash order is a repeatable random order; top-n keeps at most this many rows per task
    sample = df.select(key).orderBy(F.xxhash64(key), key).limit(min(20 * n_ranges, 20_000))
    picked = sorted(r[0] for r in sample.collect() if r[0] is not None)
    limits = sorted({picked[len(picked) * i // n_ranges] for i in range(1, n_ranges)}) if picked else []
    ranged = df.withColumn("_range", _place_among(F.col(key), limits))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # n_ranges rows
    inside = F.row_number().over(W.Window.partitionBy("_range").orderBy(key))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_offset") + F.col("_inside") - 1 + start)
        .drop("_range", "_offset", "_inside")
    )
