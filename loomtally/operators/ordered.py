"""Ordered operators over tables too large for one task.

A running total (or the row that follows) in a global order needs no global
sort in one partition: rows are dealt to ranges of the order key, each range is
folded alone, and only one row per range is folded over all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ranges-1 increasing cut points of an integer key, from approximate
    quantiles over all rows (bounded by `ranges`, whatever the input)."""
    if ranges <= 1:
        return []
    at = [i / ranges for i in range(1, ranges)]
    got = df.select(F.percentile_approx(F.col(key), at, 20 * ranges).alias("q")).first()["q"]
    return sorted({int(x) for x in got or [] if x is not None})


def range_of(key: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds that are <= key; null is 0. By a binary tree of comparisons, or by
    bisecting an array where the tree would be too large to compile."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(bounds) <= 256:
        found = tree(0, len(bounds))
    else:
        at, n = F.lit(np.array(bounds, dtype=np.int64)), len(bounds)
        steps = F.sequence(F.lit(n.bit_length() - 1), F.lit(0))
        # the greatest place whose bound is <= key, built from its highest bit down
        found = F.aggregate(steps, F.lit(0), lambda a, b: a + F.when(F.coalesce(F.get(at, a + F.call_function("shiftleft", F.lit(1), b) - 1) <= key, F.lit(False)), F.call_function("shiftleft", F.lit(1), b)).otherwise(0))
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def ranges_of_bytes(df: DataFrame, column: str, each: int = 16 << 20, most: int = 10_000) -> int:
    """How many ranges of about `each` bytes of a text column there are; `most` of larger ones."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, min(most, -(-total // each)))


def default_ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_before(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "before", ranges: int | None = None
) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `by` that come
    earlier in `order` (first order column: integer; nulls first).

    df is read three times, so a costly input should be durable. A null value
    counts as 0; rows equal in every order column are taken in an arbitrary
    order among themselves.
    """
    bounds = range_bounds(df, order[0], ranges or default_ranges(df))
    dealt = df.withColumn("_range", range_of(F.col(order[0]), bounds))
    sums = dealt.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    match = F.col("_range") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (
        inside.join(offsets, match, "left")
        .withColumn(out, F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_inside"))
        .drop("_range", "_at", "_offset", "_inside", "_sum", *[f"_by_{c}" for c in by])
    )
