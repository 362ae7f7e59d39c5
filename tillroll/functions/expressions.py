"""Column expressions used by the retail analyses. All stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(column: str | Column, values: Sequence) -> Column:
    """Set membership that is never NULL: a NULL is a member if ``values`` has one.

    All parts of the condition can be pushed to a Parquet scan.
    """
    column = F.col(column) if isinstance(column, str) else column
    known = [v for v in values if v is not None]
    found = column.isNotNull() & column.isin(known)
    return found if len(known) == len(values) else found | column.isNull()


def classify(column: str | Column, groups: Mapping[str, Sequence]) -> Column:
    """Label of the first group that holds the value; NULL when none does.

    For short value lists. A mapping of table size belongs in a DataFrame joined
    by ``operators.joins.left_lookup``.
    """
    column = F.col(column) if isinstance(column, str) else column
    label = F.lit(None).cast("string")
    for name, values in reversed(list(groups.items())):
        label = F.when(column.isin(list(values)), F.lit(name)).otherwise(label)
    return label


def recode(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace values of ``column``; every test looks at the original value."""
    return df.replace(dict(mapping), subset=[column])


def line_total() -> Column:
    """Value of an invoice line, as an exact decimal."""
    return F.col("UnitPrice") * F.col("Quantity")


def exact_mean(total: str, count: str) -> Column:
    """Mean from an exact decimal sum, so that it does not depend on the order of addition."""
    return F.col(total).cast("double") / F.col(count)


def round_half_even(column: str | Column, digits: int = 0) -> Column:
    """Rounding with ties to the even neighbour."""
    return F.bround(column, digits)


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end``, for timestamps with or without a zone."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap)
    seconds = (part("DAY") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds.cast("bigint") * 1000000 + (part("SECOND") * 1000000).cast("bigint")


def plus_micros(start: Column, micros: Column) -> Column:
    return start + F.expr("INTERVAL '0.000001' SECOND") * micros
