"""Joins whose work grows with the product of a key's row counts, cut into bounded pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.session import cut_lineage


BROADCAST_KEYS = 1_000_000  # rows of two numbers and the key: some tens of megabytes


def hot_keys(left: DataFrame, right: DataFrame, keys: list[str], rows_per_slice: int) -> DataFrame:
    """Keys with more than ``rows_per_slice`` rows on either side, and the number of slices for each side."""
    sides = left.select(*keys, F.lit(1).alias("_l")).union(right.select(*keys, F.lit(0)))
    counts = sides.groupBy(*keys).agg(F.sum("_l").alias("_left"), F.count(F.lit(1)).alias("_all"))

    def slices(n: Column) -> Column:
        return F.greatest(F.ceil(n / rows_per_slice), F.lit(1)).cast("int")

    right_rows = F.col("_all") - F.col("_left")
    return counts.filter(F.greatest(F.col("_left"), right_rows) > rows_per_slice).select(
        *keys, slices(F.col("_left")).alias("_lcount"), slices(right_rows).alias("_rcount")
    )


def sliced_sides(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column, rows_per_slice: int
) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with their slices ``_ls`` and ``_rs`` added, or None where no key is hot.

    A left row goes to one left slice and to every right slice of its key, and the other way round, so each
    matching pair meets exactly once. Rows per key are counted first, over the key columns alone. The list of hot
    keys is broadcast if its counted size allows, and joined by a shuffle otherwise.
    """
    hot = cut_lineage(hot_keys(left, right, keys, rows_per_slice))
    n_hot = hot.count()
    if n_hot == 0:
        return None
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    one = F.lit(1)
    n_left, n_right = F.coalesce("_lcount", one), F.coalesce("_rcount", one)

    def spread(df: DataFrame, own_id: Column, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
        return (
            df.join(hot, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(own_id), own_n).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)))
            .drop("_lcount", "_rcount")
        )

    return spread(left, left_id, "_ls", n_left, "_rs", n_right), spread(right, right_id, "_rs", n_right, "_ls", n_left)


def sliced_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: Column,
    right_id: Column,
    rows_per_slice: int = 20_000,
) -> DataFrame:
    """Inner equi-join on ``keys`` where a hot key becomes a grid of (left slice, right slice) tasks.

    No task handles more than ``rows_per_slice`` squared pairs of one key. Without a hot key this is a plain join.
    """
    sides = sliced_sides(left, right, keys, left_id, right_id, rows_per_slice)
    if sides is None:
        return left.join(right, keys)
    return sides[0].join(sides[1], [*keys, "_ls", "_rs"]).drop("_ls", "_rs")
