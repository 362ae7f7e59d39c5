"""Whole numbers for rows and values, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256


def lower_sums(sizes: Column, parts: int) -> Column:
    """From a list of (part, n), the sum of n over all lower parts, for each part from 0."""
    zero = F.lit(0).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda p: F.aggregate(F.filter(sizes, lambda s: s["part"] < p), zero, lambda total, s: total + s["n"]),
    )


def numbered_within(df: DataFrame, part: str, parts: int, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, the row's number from 0: by ``part`` (a whole number below ``parts``),
    then by ``order``, which must tell the rows of a part apart.

    Rows are numbered within their parts; the sizes of the lower parts, a list of ``parts``
    numbers, are added. ``df`` is read twice, which must give the same rows.
    """
    sizes = df.groupBy(part).agg(F.sum(F.lit(1).cast("bigint")).alias("n"))
    listed = sizes.agg(F.collect_list(F.struct(F.col(part).cast("int").alias("part"), "n")).alias("s"))
    below = listed.select(lower_sums(F.col("s"), parts).alias("below")).scalar()
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    rows = df.withColumn("_within", within).withColumn("_below", below)
    first = F.get(F.col("_below"), F.col(part).cast("int"))
    return rows.withColumn(name, first + F.col("_within") - 1).drop("_within", "_below")


def value_codes(df: DataFrame, column: str, name: str, after: int = 0) -> DataFrame:
    """The different values of ``column`` and their codes ``name``: 0 for NULL, the others
    ``after`` + 1, ``after`` + 2 and so on, in no order that means anything.

    Codes depend on the values alone. Values are dealt by hash, so no task has them all.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = values.withColumn("_part", F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int"))
    coded = numbered_within(dealt, "_part", PARTS, [column], name)
    coded = coded.select(column, (F.col(name) + after + 1).alias(name))
    null = df.select(column).where(F.col(column).isNull()).distinct()
    return coded.unionByName(null.withColumn(name, F.lit(0).cast("bigint")))


def file_offsets(positions: DataFrame, path: str, index: str) -> DataFrame:
    """``path`` and ``before``, the number of rows in the files whose paths come before it.

    ``positions`` has the path and the position of every row. There is a row for each
    file, of which the driver lists them all anyway, so they are summed in one task.
    """
    sizes = positions.groupBy(path).agg((F.max(index) + 1).alias("_rows"))
    earlier = Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(path, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("before"))
