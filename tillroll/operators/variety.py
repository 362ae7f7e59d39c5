"""Distinct counts that merge: bitmaps of value codes (exact) and HyperLogLog sketches (approximate).

Both are small, are built without moving (group, value) pairs, and the results for
parts of the data, or for groups of groups, are merged without the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The logarithm of a sketch's registers; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def bitmaps(df: DataFrame, group: str, code: str) -> DataFrame:
    """(group, bucket, bitmap): which codes occur in each group.

    Codes are whole numbers, 0 for NULL, which has bucket 0 for itself. A bitmap covers 32,768
    codes in 4 KB, so a task sends at most that for each group and bucket it has met.
    """
    position, bucket = F.bitmap_bit_position(code), F.bitmap_bucket_number(code)
    return df.groupBy(group, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap"))


def merge_bitmaps(df: DataFrame, group: str) -> DataFrame:
    """One bitmap for each group and bucket."""
    return df.groupBy(group, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_bitmaps(df: DataFrame, group: str, include_null: bool = True) -> DataFrame:
    """Different codes per group, as ``n``; of groups with NULL alone, too."""
    n = F.bitmap_count("bitmap")
    if not include_null:
        n = F.when(F.col("bucket") > 0, n).otherwise(0)
    return merge_bitmaps(df, group).groupBy(group).agg(F.sum(n).alias("n"))


def sketches(df: DataFrame, group: str, value: str, lg_k: int = LG_K) -> DataFrame:
    """(group, sketch, has_null) of the values of each group."""
    return df.groupBy(group).agg(
        F.hll_sketch_agg(value, lg_k).alias("sketch"), F.bool_or(F.col(value).isNull()).alias("has_null")
    )


def merge_sketches(df: DataFrame, group: str) -> DataFrame:
    """One sketch for each group; sketches of different sizes merge to the smaller one."""
    return df.groupBy(group).agg(
        F.hll_union_agg("sketch", True).alias("sketch"), F.bool_or("has_null").alias("has_null")
    )


def estimate_sketches(df: DataFrame, group: str, include_null: bool = True) -> DataFrame:
    """Estimated number of different values per group, as ``n``; NULL is one value."""
    n = F.hll_sketch_estimate("sketch")
    if include_null:
        n = n + F.col("has_null").cast("bigint")
    return merge_sketches(df, group).select(group, n.alias("n"))
