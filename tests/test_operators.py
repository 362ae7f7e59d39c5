from datetime import datetime, timedelta
from decimal import Decimal

import re

import pytest
from pyspark.sql import functions as F

from tillroll.functions.expressions import (
    classify,
    is_in,
    micros_between,
    plus_micros,
    recode,
    round_half_even,
)
from tillroll.operators.aggregates import count_distinct_by, mean_by
from tillroll.operators.histogram import time_histogram
from tillroll.operators.joins import inner_lookup, keep_matching, left_lookup, natural_left_join
from tillroll.operators.keyed import distinct_rows, distinct_with_first, first_by_key
from tillroll.operators.ranking import descending, factor_code, share_of_total, top_n
from tillroll.schema import MAP_NAMES, REGIONS


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return sorted(rows(df), key=repr)


def test_is_in_with_null_in_the_list(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(df.select(is_in("x", ["a", None]), ~is_in("x", ["a", None]))) == [
        (True, False), (False, True), (True, False),
    ]


def test_factor_code_of_many_values(spark):
    df = spark.range(5000).selectExpr("(id * id) % 7919 AS n")
    rank = {v: i for i, v in enumerate(sorted({k * k % 7919 for k in range(5000)}), 1)}
    coded = factor_code(df, "n", "code")
    assert all(rank[r.n] == r.code for r in coded.collect())
    assert "Window [row_number() windowspecdefinition(n" not in coded._jdf.queryExecution().executedPlan().toString()


def test_histogram_is_binned_before_the_shuffle(spark):
    df = spark.range(3000).selectExpr("timestamp_micros(id * 1000003) t", "id % 3 AS g")
    binned = time_histogram(df, "t", "g")
    assert sum(r.n for r in binned.collect()) == 3000
    plan = binned._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(t#", plan)


def test_is_in_is_never_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(df.select(is_in("x", ["a"]), ~is_in("x", ["a"]))) == [
        (True, False), (False, True), (False, True),
    ]


def test_classify_first_match_wins_and_no_default(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    groups = {"first": ["a", "b"], "second": ["b"]}
    assert rows(df.select(classify("x", groups))) == [("first",), ("first",), (None,), (None,)]


def test_reference_data():
    countries = [c for cs in REGIONS.values() for c in cs]
    assert len(REGIONS) == 9 and len(countries) == len(set(countries)) == 38
    assert len({MAP_NAMES.get(c, c) for c in countries}) == 37


def test_recode_is_simultaneous(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    assert rows(recode(df, "x", {"a": "b", "b": "c"})) == [("b",), ("c",), ("c",), (None,)]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,), (None,)], "x double")
    assert [r[0] for r in rows(df.select(round_half_even("x")))] == [0, 2, 2, 0, 2, None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_micros(spark, kind):
    a, b = datetime(2010, 12, 1, 8, 26), datetime(2011, 12, 9, 12, 50, 1, 250001)
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    gap = (b - a) // timedelta(microseconds=1)
    shown = df.select(micros_between(F.col("a"), F.col("b")), micros_between(F.col("b"), F.col("a")))
    assert rows(shown) == [(gap, -gap)]
    back = df.select(plus_micros(F.col("a"), micros_between(F.col("a"), F.col("b"))))
    assert rows(back) == [(b,)]
    assert back.schema[0].dataType.typeName() == kind


def test_micros_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The clocks went forward there between the two.
        df = spark.createDataFrame(
            [(datetime(2011, 3, 13, 1, 0), datetime(2011, 3, 13, 4, 0))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        assert rows(df.select(micros_between(F.col("a"), F.col("b")))) == [(3 * 3600 * 10**6,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_distinct_rows_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("x", None)], "x string, y string")
    assert bag(distinct_rows(df, "x", "y")) == [("x", None), (None, "a")]
    assert bag(distinct_rows(df, "x")) == [("x",), (None,)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_first_by_key(spark, partitions):
    data = [
        ("a", 3, "late", 1), ("a", 1, None, 2), ("a", 2, "mid", None),
        (None, 5, "n2", 1), (None, 4, "n1", None), ("b", 9, "only", 7),
    ]
    df = spark.createDataFrame(data, "k string, o long, v string, w int").repartition(partitions)
    first = first_by_key(df, "k", ["v", "w"], "o", [F.count(F.lit(1)).alias("n")])
    assert first.columns == ["k", "v", "w", "n"]
    assert bag(first) == sorted([("a", None, 2, 3), ("b", "only", 7, 1), (None, "n1", None, 2)], key=repr)


def test_first_by_key_with_struct_order(spark):
    df = spark.createDataFrame([("a", 1, "y", 2), ("a", 1, "x", 9), ("a", 0, "z", 5)], "k string, p int, q string, v int")
    df = df.withColumn("o", F.struct("p", "q"))
    assert rows(first_by_key(df, "k", ["v"], "o")) == [("a", 5)]
    assert rows(first_by_key(df.where("p = 1"), "k", ["v"], "o")) == [("a", 9)]


@pytest.mark.parametrize("struct", [False, True])
def test_distinct_with_first(spark, struct):
    data = [("a", "x", "f2", 1), ("a", "x", "f1", 7), ("a", "x", "f1", 5), ("a", None, "f1", 6), (None, None, "f3", 2)]
    df = spark.createDataFrame(data, "k string, v string, f string, i long")
    df = df.withColumn("o", F.struct("f", "i") if struct else F.col("i"))
    found = distinct_with_first(df, "k", "v", order="o")
    assert found.schema["o"].dataType == df.schema["o"].dataType
    if struct:
        assert ("a", "x", ("f1", 5)) in rows(found) and ("a", "x", ("f1", 7)) not in rows(found)
    else:
        assert bag(found) == sorted([("a", "x", 1), ("a", None, 6), (None, None, 2)], key=repr)
    assert bag(first_by_key(found, "k", ["v"], "o")) == bag(first_by_key(df, "k", ["v"], "o"))


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", "A"), (None, "N"), ("c", "C")], "k string, y string")
    return left, right


def test_lookups_match_nulls(sides):
    left, right = sides
    assert bag(left_lookup(left, right, "k")) == sorted(
        [("a", 1, "A"), ("a", 1, "A"), ("b", 2, None), (None, 3, "N")], key=repr
    )
    assert bag(inner_lookup(left, right, "k")) == sorted([("a", 1, "A"), ("a", 1, "A"), (None, 3, "N")], key=repr)
    assert bag(keep_matching(left, right, "k")) == sorted([("a", 1), ("a", 1), (None, 3)], key=repr)


def test_lookups_with_plain_equality(sides):
    left, right = sides
    assert (None, 3, None) in rows(left_lookup(left, right, "k", null_safe=False))
    assert bag(keep_matching(left, right, "k", null_safe=False)) == [("a", 1), ("a", 1)]


def test_lookup_with_other_key_name(sides):
    left, right = sides
    joined = left_lookup(left, right.withColumnRenamed("k", "code"), {"k": "code"})
    assert joined.columns == ["k", "x", "y"]
    assert bag(joined) == bag(left_lookup(left, right, "k"))


def test_natural_join(spark, sides):
    left, right = sides
    assert bag(natural_left_join(left, right)) == bag(left_lookup(left, right, "k"))
    two = spark.createDataFrame([("a", 1, "m"), (None, 4, "no")], "k string, x int, z string")
    assert bag(natural_left_join(left, two)) == sorted(
        [("a", 1, "m"), ("a", 1, "m"), ("b", 2, None), (None, 3, None)], key=repr
    )
    with pytest.raises(ValueError):
        natural_left_join(left, right.select("y"))


def test_count_distinct_counts_null(spark):
    df = spark.createDataFrame([("g", "a"), ("g", None), ("g", None), (None, "a"), ("h", None)], "g string, v string")
    assert dict(rows(count_distinct_by(df, "g", "v"))) == {"g": 2, None: 1, "h": 1}
    assert dict(rows(count_distinct_by(df, "g", "v", include_null=False))) == {"g": 1, None: 1, "h": 0}


def test_mean_by_is_exact(spark):
    df = spark.createDataFrame([("g", Decimal("0.100"))] * 3 + [("g", None)], "g string, v decimal(12,3)")
    assert rows(mean_by(df, "g", "v", "m")) == [("g", 0.3 / 3)]


def test_descending_and_top(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 1), ("z", None), ("c", 5)], "k string, n int")
    assert rows(descending(df, "n", "k")) == [("c", 5), ("a", 1), ("b", 1), (None, 1), ("z", None)]
    assert rows(top_n(df, 2, "n", "k")) == [("c", 5), ("a", 1)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", Decimal(1)), ("b", Decimal(3)), ("c", None)], "k string, v decimal(10,2)")
    assert bag(share_of_total(df, "v", "share").select("k", "share")) == [("a", 0.25), ("b", 0.75), ("c", None)]
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    assert bag(share_of_total(zero, "v", "share").select("share")) == [(None,), (None,)]


def test_factor_code(spark):
    df = spark.createDataFrame([("a", 7), ("b", 2), ("c", 7), ("d", 100), ("e", None)], "k string, n long")
    assert bag(factor_code(df, "n", "code")) == [
        ("a", 7, 2), ("b", 2, 1), ("c", 7, 2), ("d", 100, 3), ("e", None, None),
    ]


def test_histogram_edges(spark):
    """29 days in 30 bins: bins are a day wide, each day in the middle of its own; noon is an edge."""
    start = datetime(2011, 1, 1)
    times = [start + timedelta(days=d) for d in (0, 1, 29)]
    times += [start + timedelta(hours=12), start + timedelta(hours=12, microseconds=1), None]
    df = spark.createDataFrame([(t, "g") for t in times], "t timestamp_ntz, g string")
    got = {r.bin: r for r in time_histogram(df, "t", "g").collect()}
    assert {b: r.n for b, r in got.items()} == {1: 2, 2: 2, 30: 1}
    assert got[1].bin_start == start - timedelta(hours=12)
    assert got[1].bin_end == got[2].bin_start == start + timedelta(hours=12)


def test_histogram_of_one_time(spark):
    df = spark.createDataFrame([(datetime(2011, 1, 1), "g", 4)] * 2, "t timestamp_ntz, g string, w int")
    [r] = time_histogram(df, "t", "g", "w").collect()
    assert (r.bin, r.bin_start, r.bin_end, r.g, r.n) == (1, datetime(2011, 1, 1), datetime(2011, 1, 1), "g", 8)
    with pytest.raises(ValueError):
        time_histogram(df, "t", "g", bins=1)
