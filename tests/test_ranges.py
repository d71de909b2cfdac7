"""Ranges of an order key."""

import bisect

from pyspark.sql import functions as F

from loomtally.operators.ordered import range_of, ranges_of_bytes


def test_range_of_counts_bounds_in_both_forms(spark):
    keys = [*range(-3, 2100, 7), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for bounds in ([], [5], list(range(0, 500, 2)), list(range(0, 2000, 3)), list(range(0, 1024))):
        got = [r[0] for r in df.select(range_of(F.col("k"), bounds)).collect()]
        assert got == [0 if k is None else bisect.bisect_right(bounds, k) for k in keys]


def test_number_of_ranges_follows_the_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("é"), 50).alias("t"))
    assert ranges_of_bytes(df, "t", 1000) == 10 and ranges_of_bytes(df, "t", 1000, 4) == 4 and ranges_of_bytes(df.limit(0), "t") == 1
