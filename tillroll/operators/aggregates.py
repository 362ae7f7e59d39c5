"""Grouped counts and sums. Grouping by NULL makes a group of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import exact_mean


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, as ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_distinct_by(df: DataFrame, group: str, value: str, include_null: bool = True) -> DataFrame:
    """Different values per group, as ``n``; NULL counts as one value.

    The pairs are made distinct first, on a shuffle keyed by group and value, so
    a dominant group spreads over all tasks.
    """
    pairs = df.select(group, value).distinct()
    n = F.count(F.lit(1)) if include_null else F.count(value)
    return pairs.groupBy(group).agg(n.alias("n"))


def mean_count(counted: DataFrame) -> DataFrame:
    """Mean of the counts ``n`` over all groups, as ``mean_n``."""
    sums = counted.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))
    return sums.select(F.try_divide(F.col("rows").cast("double"), "groups").alias("mean_n"))


def sum_by(df: DataFrame, key: str, value: str | Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def mean_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Mean of a decimal column per key."""
    sums = df.groupBy(key).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    return sums.select(key, exact_mean("_sum", "_count").alias(name))
