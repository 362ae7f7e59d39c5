"""Lookup of names that are not spelt alike: the one closest name of a table, or none.

Names are compared without regard to case and to white space around and between words. A name may differ
by one edit (a character more, less or other) from three characters on, by two from six on; the longer
of the two names counts. Nothing is lost and no two tables are crossed: names that differ
by k edits have all but 3k of their padded trigrams in common, so that among the 3k + 1 rarest of
each there is a common one. Only pairs with such a trigram are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.joins import left_lookup

EDITS = 2
_START, _END = "\u0001\u0001", "\u0002\u0002"


def folded(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def allowed_edits(length: Column) -> Column:
    return F.when(length < 3, 0).when(length < 6, 1).otherwise(EDITS)


def _grams(names: DataFrame) -> DataFrame:
    """(name, gram): the padded trigrams of each name; a repeated one has its number behind it."""
    padded = F.concat(F.lit(_START), "name", F.lit(_END))
    starts = F.sequence(F.lit(1), F.char_length("name") + 2)
    rows = names.select("name", F.posexplode(F.transform(starts, lambda i: F.substring(padded, i, 3))))
    again = F.row_number().over(Window.partitionBy("name", "col").orderBy("pos"))
    return rows.select("name", F.concat_ws("\u0003", "col", again).alias("gram"))


def _rarest(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Each name's rarest trigrams, as many as a partner must share one of."""
    needed = 3 * allowed_edits(F.char_length("name") + EDITS) + 1
    counted = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("n", "gram"))
    return counted.withColumn("_rank", rank).where(F.col("_rank") <= needed).select("gram", "name")


def closest_names(names: DataFrame, column: str, places: DataFrame, place: str) -> DataFrame:
    """(``column``, ``match``, ``distance``) for each different name that has one closest ``place``.

    If several places are as close, the name has no row, unless one is spelt exactly alike.
    """
    wanted = names.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    wanted = wanted.withColumn("name", folded(column))
    known = places.select(F.col(place).alias("match")).where(F.col(place).isNotNull()).distinct()
    known = known.withColumn("name", folded("match"))
    left, right = (_grams(side.select("name").where("name != ''").distinct()) for side in (wanted, known))
    counts = right.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pairs = _rarest(left, counts).join(
        _rarest(right, counts).withColumnRenamed("name", "other"), "gram"
    )
    # The shorter the trigram lists, the fewer pairs: lengths are compared before the names.
    lengths = F.abs(F.char_length("name") - F.char_length("other"))
    edits = allowed_edits(F.greatest(F.char_length("name"), F.char_length("other")))
    pairs = pairs.where(lengths <= edits).select("name", "other").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("name", "other", EDITS))
    pairs = pairs.where((F.col("distance") >= 0) & (F.col("distance") <= edits))

    spelt = known.withColumnRenamed("name", "other")
    found = wanted.join(pairs, "name").join(spelt, "other")
    # 0 for the same spelling, then by edits; names that fold alike have 1.
    rank = F.when(F.col(column) == F.col("match"), 0).otherwise(F.col("distance") + 1)
    ranked = found.groupBy(column, rank.alias("_rank")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("match").alias("match"), F.min("distance").alias("distance")
    )
    best = ranked.groupBy(column).agg(F.min(F.struct("_rank", "_n", "match", "distance")).alias("b"))
    return best.where("b._n = 1").select(column, "b.match", F.col("b.distance").alias("distance"))


def fuzzy_lookup(df: DataFrame, right: DataFrame, on: str, right_on: str) -> DataFrame:
    """All rows of ``df`` with the columns of the one row of ``right`` whose name is closest, and
    ``distance``; NULLs where there is none, or several are as close.

    Names are matched once each, however many rows have them.
    """
    matched = closest_names(df, on, right, right_on).withColumnsRenamed({on: "_name", "match": "_match"})
    looked = left_lookup(df, matched, {on: "_name"}, null_safe=False)
    found = right.withColumnRenamed(right_on, "_right_name")
    return left_lookup(looked, found, {"_match": "_right_name"}, null_safe=False).drop("_match")
