"""Equal-width time histogram by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import micros_between, plus_micros
from tillroll.operators.joins import left_lookup


def time_histogram(
    df: DataFrame,
    time: str,
    category: str,
    weight: str | None = None,
    bins: int = 30,
    dense: bool = False,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Rows (or summed ``weight``) per time bin and category: bin, bin_start, bin_end, category, n.

    With R the range of the times, a bin is R / (bins - 1) wide, the first is
    centred on the earliest time, and a bin holds its right edge. Bins are found
    by integer arithmetic on microseconds, exact also for times on an edge. Rows
    without a time are left out. ``dense`` adds the empty bins of each category. ``bounds`` has
    the known range in one row (low, high); without it the rows are read for it.
    """
    if bins < 2:
        raise ValueError("a histogram needs at least two bins")
    steps = 2 * (bins - 1)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    dated = df.where(F.col(time).isNotNull())
    if bounds is None:
        # The other columns are read here as well, so that this branch has the same
        # shuffles below it as the main one and Spark runs them once.
        bounds = dated.agg(
            F.struct(
                F.min(time).alias("low"),
                F.max(time).alias("high"),
                n.alias("n"),
                F.count(category).alias("c"),
            )
        )
    else:
        bounds = bounds.select(F.struct("low", "high"))
    placed = (
        dated.withColumn("_bounds", bounds.scalar())
        .withColumn("_low", F.col("_bounds.low"))
        .withColumn("_range", micros_between(F.col("_low"), F.col("_bounds.high")))
        .withColumn("_after", micros_between(F.col("_low"), F.col(time)))
        .withColumn(
            "bin",
            F.expr(f"if(_range = 0, 1L, ({steps} * _after + 3 * _range - 1) div (2 * _range))"),
        )
    )
    # Rows are binned before they are summed, so that at most bins times categories rows
    # of each task are shuffled, however fine the times are.
    binned = placed.groupBy("bin", "_low", "_range", category).agg(n.cast("bigint").alias("n"))
    if dense:
        groups = binned.select("_low", "_range", category).distinct()
        every = groups.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
        binned = left_lookup(
            every, binned.select("bin", category, "n"), ["bin", category]
        ).fillna(0, ["n"])
    # Edges are floored to whole microseconds; the added range keeps the dividend positive.
    edge = lambda k: plus_micros(
        F.col("_low"), F.expr(f"((2 * bin + {k} + {steps}) * _range) div {steps} - _range")
    )
    return binned.select(
        "bin", edge(-3).alias("bin_start"), edge(-1).alias("bin_end"), category, "n"
    )
