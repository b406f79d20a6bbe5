"""Ranks in a stated order without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, 3, … within ``keys`` in the order of ``bucket`` and then ``order``; and ``total``, the key's rows.

    ``bucket`` rises with the order and parts a large key into pieces, of which only single ones are sorted: the counts
    of the pieces before give each its first rank. Keys may be null. With no keys one rank runs over all rows.
    """
    cut = df.withColumn("_b", bucket)
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(whole).alias("_total"),
    )
    ranked = cut.withColumn("_w", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    same = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = ranked.join(firsts, same).withColumn(name, F.col("_first") + F.col("_w"))
    if total:
        found = found.withColumn(total, F.col("_total"))
    return found.drop("_b", "_w", "_first", "_total", "_kb", *[f"_k{i}" for i in range(len(keys))])


def id_bucket(column: str, width: int = 65_536) -> Column:
    """Pieces of ``width`` neighbouring ids."""
    return F.floor(F.col(column) / width)
