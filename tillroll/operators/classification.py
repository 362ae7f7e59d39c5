"""Classification by a table of values, for maps of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.joins import left_lookup


def branches(spark: SparkSession, groups: Mapping[str, Sequence]) -> DataFrame:
    """(branch, value, label) of a mapping of labels to values, numbered in its order."""
    rows = [(i, v, label) for i, (label, values) in enumerate(groups.items()) for v in values]
    return spark.createDataFrame(rows, "branch bigint, value string, label string")


def first_branches(table: DataFrame, value: str = "value", label: str = "label", branch: str = "branch") -> DataFrame:
    """One row for each value: the label of its branch with the lowest number.

    Of labels of one branch the least counts, so repeated rows and ties do no harm. Rows without a
    value or a branch match nothing, as in a comparison.
    """
    rows = table.where(F.col(value).isNotNull() & F.col(branch).isNotNull())
    first = F.min(F.struct(branch, F.col(label).isNull(), label)).alias("_first")
    return rows.groupBy(value).agg(first).select(value, F.col("_first")[label].alias(label))


def classify_by_table(
    df: DataFrame,
    column: str,
    table: DataFrame,
    name: str,
    default: str | None = None,
    value: str = "value",
    label: str = "label",
    branch: str = "branch",
) -> DataFrame:
    """``df`` with ``name``, the label of the first branch of ``table`` that has the value of ``column``.

    The same as a chain of conditions in the order of ``branch``, but joined, so that the plan does not
    grow with the table: the table is reduced to a row for each value first, and Spark broadcasts
    that if it is small. ``default`` is for values that no branch has, NULL among them.
    """
    found = first_branches(table, value, label, branch).select(
        F.col(value).alias("_value"), F.col(label).alias("_label"), F.lit(True).alias("_found")
    )
    joined = left_lookup(df, found, {column: "_value"}, null_safe=False)
    chosen = F.when(F.col("_found"), F.col("_label")).otherwise(F.lit(default))
    return joined.withColumn(name, chosen).drop("_label", "_found")
