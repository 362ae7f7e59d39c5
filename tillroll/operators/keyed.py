"""Distinct rows and first row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations of ``columns``; NULL equals NULL."""
    return df.select(*columns).distinct()


def first_by_key(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    order: str,
    aggregates: Sequence[Column] = (),
    mixed: str | None = None,
) -> DataFrame:
    """``key`` and the ``values`` of its first row by ``order``, plus ``aggregates`` (named sums
    and counts) over its rows.

    ``min`` of a struct that starts with the order column takes all values from
    one row, NULLs included, whatever the partitioning. It is an aggregate, so
    each map task sends one row per key and a key that holds much of the table
    costs the reducer one row per map task; a window would sort all its rows in
    one task. Pass only the values needed: the struct is not pruned.

    Spark aggregates a struct by sorting. Hashing by key and values first, or finding
    the lowest order alone and joining the row it stands for, avoids the sort and was slower
    wherever keys are many (README); where they are few, put ``distinct_with_first`` in front.
    ``mixed`` names a column that says whether the values of a key differ; it compares the
    extremes of two 64-bit hashes.
    """
    first = F.min(F.struct(order, *values)).alias("_first")
    more = []
    if mixed:
        said = [*[F.isnull(v) for v in values], *values]
        hashes = [F.xxhash64(*said), F.xxhash64(F.lit(1), *said)]
        differ = [F.min(h) != F.max(h) for h in hashes]
        more = [(differ[0] | differ[1]).alias(mixed)]
    rows = df.groupBy(key).agg(first, *aggregates, *more)
    extra = [c for c in rows.columns if c not in (key, "_first")]
    return rows.select(key, *[F.col("_first")[v].alias(v) for v in values], *extra)


def distinct_with_first(df: DataFrame, *columns: str, order: str) -> DataFrame:
    """Distinct combinations of ``columns`` with the lowest ``order`` of their rows.

    In front of ``first_by_key`` this saves sorting the table where its rows have
    few combinations. It hashes: as a struct cannot be the buffer of a hash
    aggregate, the leading fields of a struct order join the grouping, and only
    its last field is minimised. Those leading fields should repeat within a task,
    as a file path does. A combination may come back once for each of their values.
    """
    kind = df.schema[order].dataType
    fields = kind.names if isinstance(kind, T.StructType) else []
    leading = [F.col(order)[f].alias(f"_{f}") for f in fields[:-1]]
    last = F.col(order)[fields[-1]] if fields else F.col(order)
    rows = df.groupBy(*columns, *leading).agg(F.min(last).alias("_last"))
    parts = [F.col(f"_{f}").alias(f) for f in fields[:-1]]
    lowest = F.struct(*parts, F.col("_last").alias(fields[-1])) if fields else F.col("_last")
    return rows.select(*columns, lowest.alias(order))
