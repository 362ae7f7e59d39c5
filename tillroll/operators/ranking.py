"""Sorting, top rows, shares and category codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import left_lookup
from tillroll.operators.numbering import numbered_within

# The distinct values are ranked within so many ranges, cut at quantiles of about SAMPLE of them.
RANGES = 1024
SAMPLE = 32 * RANGES


def descending(df: DataFrame, measure: str, *ties: str) -> DataFrame:
    """Sort by ``measure`` from high to low, NULLs last, ties by the key columns."""
    return df.orderBy(F.desc_nulls_last(measure), *[F.asc_nulls_last(c) for c in ties])


def top_n(df: DataFrame, n: int, measure: str, *ties: str) -> DataFrame:
    """The ``n`` first rows of ``descending``; each task keeps at most ``n``."""
    return descending(df, measure, *ties).limit(n)


def share_of_total(df: DataFrame, measure: str, name: str = "porcentage") -> DataFrame:
    """Add each row's share of the column's grand total; NULL when the total is zero.

    The total is a one-value subquery. Adaptive execution runs the shuffles it
    has in common with ``df`` once.
    """
    total = df.agg(F.sum(measure).cast("double")).scalar()
    return df.withColumn(name, F.try_divide(F.col(measure).cast("double"), total))


def ranged(values: DataFrame, column: str, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """Distinct non-null ``values`` with ``_range``, one of ``ranges`` (a power of two) ranges of about
    equal size in ascending order.

    The ranges are cut at quantiles of the values whose hash is low enough for about ``sample`` of
    them. The hash makes the sample, and so the cuts, the same in every use, which an approximate
    percentile would not promise; and as the values are distinct, no heavy tail crowds a range.
    """
    total = values.agg(F.sum(F.lit(1).cast("bigint"))).scalar()
    place = F.pmod(F.xxhash64(column), F.lit(1 << 30)).cast("double") / (1 << 30)
    drawn = values.where(place * F.coalesce(total, F.lit(0)) < sample)
    cut = lambda k: F.get(F.col("s"), F.floor(k * F.size("s") / ranges).cast("int"))
    cuts = drawn.agg(F.array_sort(F.collect_list(column)).alias("s")).select(
        F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), cut).alias("cuts")
    )
    halves = F.array(*[F.lit(ranges >> i) for i in range(1, ranges.bit_length())])
    # A binary search for the number of cuts that are not above the value.
    search = F.aggregate(
        halves,
        F.lit(0),
        lambda at, half: F.when(F.get(F.col("_cuts"), at + half - 1) <= F.col(column), at + half).otherwise(at),
    )
    return values.withColumn("_cuts", cuts.scalar()).select(column, search.alias("_range"))


def factor_code(df: DataFrame, count: str, name: str, few: bool = False) -> DataFrame:
    """Code the distinct values of a count column 1..k in ascending order; a NULL has a NULL code.

    Values are ranked within ranges of about equal size, and the sizes of lower ranges are added, so
    no task ranks them all. ``few`` is for frames of report size, a row for each country
    say: their values are one sorted list, and there is no join.
    """
    if few:
        values = df.agg(F.array_sort(F.collect_set(count)).alias("values")).scalar()
        return df.withColumn("_values", values).select(
            *df.columns, F.array_position(F.col("_values"), F.col(count)).alias(name)
        )
    values = df.select(count).where(F.col(count).isNotNull()).distinct()
    codes = numbered_within(ranged(values, count), "_range", RANGES, [count], name)
    codes = codes.select(count, (F.col(name) + 1).alias(name))
    return left_lookup(df, codes, count, null_safe=False)
