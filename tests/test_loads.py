"""Numbers of lines, loads that are merged, lines set aside, large classifications, misspelt names, distinct counts
that merge."""

import json
import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from data import D1, TINY, Brute, frame, line, random_rows
from pyspark.sql import functions as F
from test_plans import final_plan, first_plan

from tillroll import Retail, StoredRetail, load_checked, locate, read_retail
from tillroll.operators.classification import branches, classify_by_table, first_branches
from tillroll.operators.fuzzy import allowed_edits, closest_names, fuzzy_lookup
from tillroll.operators.histogram import time_histogram
from tillroll.operators.numbering import numbered_within, value_codes
from tillroll.operators.ranking import RANGES, factor_code, ranged
from tillroll.operators.variety import (
    LG_K,
    bitmaps,
    count_bitmaps,
    estimate_sketches,
    merge_sketches,
    sketches,
)
from tillroll.plans import analyses as a
from tillroll.schema import REGIONS, RETAIL_SCHEMA, ROW_ORDER
from tillroll.sources import retail as reader
from tillroll.sources.retail import check_lines


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return Counter(rows(df))


# --- numbers


@pytest.mark.parametrize("many", [100_000, 0])
def test_dense_numbers_follow_the_files(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(reader, "MANY_FILES", many)
    data = random_rows(31, 700)
    df = frame(spark, data).coalesce(1).drop(ROW_ORDER)
    df.write.option("maxRecordsPerFile", 90).parquet(str(tmp_path / "t"))
    lines = read_retail(spark, str(tmp_path / "t"), dense=True)
    assert lines.columns == [*RETAIL_SCHEMA.names, ROW_ORDER]
    found = sorted(rows(lines), key=lambda r: r[-1])
    assert [r[-1] for r in found] == list(range(700))
    by_place = read_retail(spark, str(tmp_path / "t")).orderBy(ROW_ORDER)
    assert [r[:-1] for r in found] == [tuple(r)[:-1] for r in by_place.collect()]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ("BroadcastHashJoin" in first_plan(read_retail(spark, str(tmp_path / "t"), dense=True))) == (many > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert bag(Retail(lines).clean()) == bag(Retail(by_place).clean())
    with pytest.raises(ValueError, match="position"):
        read_retail(spark, str(tmp_path / "t"), "csv", dense=True)


def test_numbers_within_parts(spark):
    df = spark.createDataFrame([(2, "b"), (0, "z"), (2, "a"), (7, "c")], "part int, v string")
    assert sorted(rows(numbered_within(df, "part", 8, ["v"], "n"))) == [(0, "z", 0), (2, "a", 1), (2, "b", 2), (7, "c", 3)]


def test_codes_of_values(spark):
    df = spark.createDataFrame([(v,) for v in [None, "a", "b", "a", None, *map(str, range(2000))]], "v string")
    codes = dict(rows(value_codes(df, "v", "code", 5)))
    assert codes.pop(None) == 0 and sorted(codes.values()) == list(range(6, 2008))
    assert dict(rows(value_codes(df.repartition(9).dropna(), "v", "code", 5))) == codes
    assert value_codes(df.limit(0), "v", "code").count() == 0


def test_ranges_of_a_heavy_tail(spark):
    """One value of 10^9 beside 10^6 small ones: ranges stay even."""
    values = spark.range(10**6).selectExpr("id AS n").unionByName(spark.sql("SELECT 1000000000L AS n"))
    sizes = sorted(r["count"] for r in ranged(values, "n").groupBy("_range").count().collect())
    assert len(sizes) > RANGES / 2 and sizes[-1] < 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("few", [False, True])
def test_codes_of_counts(spark, few):
    rng = random.Random(32)
    data = [(i, rng.choice([None, 10**9, -5, *(rng.randrange(900) for _ in range(20))])) for i in range(3000)]
    rank = {v: i for i, v in enumerate(sorted({n for _, n in data if n is not None}), 1)} | {None: None}
    df = spark.createDataFrame(data, "k int, n bigint")
    assert sorted(rows(factor_code(df, "n", "code", few))) == [(k, n, rank[n]) for k, n in data]
    assert factor_code(df.limit(0), "n", "code", few).count() == 0
    assert bag(factor_code(df.where("n IS NULL"), "n", "code", few).select("code")).keys() <= {(None,)}


# --- loads


def split(seed, n=500):
    data = random_rows(seed, n) + TINY
    return data, n // 2


def stored(spark, tmp_path, name, data):
    return Retail(frame(spark, data)).store(str(tmp_path / name))


def test_two_loads_are_one_model(spark, tmp_path):
    data, cut = split(33)
    both = stored(spark, tmp_path, "both", data)
    one = stored(spark, tmp_path, "merged", data[:cut])
    merged = one.add(frame(spark, data[cut:], 3))
    assert merged.version == 1 and StoredRetail(spark, one.folder).version == 1
    for table in ("facts", "products"):
        columns = [c for c in both.table(table).columns if c not in ("code", ROW_ORDER)]
        assert bag(merged.table(table).select(columns)) == bag(both.table(table).select(columns)), table
    assert bag(merged.clean()) == bag(both.clean())
    assert sorted(rows(merged.table("times")), key=repr) == sorted(rows(both.table("times")), key=repr)
    assert rows(merged.table("meta").drop("next")) == rows(both.table("meta").drop("next"))
    codes = dict(rows(merged.table("products").select("StockCode", "code")))
    assert len(set(codes.values())) == len(codes)
    for analysis in (
        a.sales_by_country, a.purchases_per_customer, a.sku_by_country, a.sku_by_region, a.products_by_country,
        a.customers_by_country, a.hist_lines_region, a.hist_invoices_country, a.price_by_region_sku,
    ):
        assert bag(analysis(merged)) == bag(analysis(both)), analysis
    expected = Brute(data)
    assert rows(a.sku_by_country(merged)) == expected.variety("Country", "StockCode")
    assert rows(a.customers_by_country(merged)) == expected.variety("Geo", "CustomerID")
    # The first version is still what it was.
    assert bag(one.clean()) == bag(stored(spark, tmp_path, "again", data[:cut]).clean())
    merged.remove()
    assert not (tmp_path / "merged").exists()


def test_three_loads_and_empty_ones(spark, tmp_path):
    data, cut = split(34, 300)
    parts = [[], data[:cut], [], data[cut:]]
    model = stored(spark, tmp_path, "m", parts[0])
    for part in parts[1:]:
        model = model.add(frame(spark, part))
    both = stored(spark, tmp_path, "both", data)
    assert model.version == 3 and bag(model.clean()) == bag(both.clean())
    assert rows(a.sku_by_region(model)) == rows(a.sku_by_region(both))
    assert bag(a.hist_lines_region(model)) == bag(a.hist_lines_region(both))


def test_only_touched_invoices_are_repaired(spark, tmp_path):
    first = [line(str(i), "s", "d", 1, D1, "1.000", "c", "France") for i in range(300)]
    second = [line("7", "s", "d", 1, D1, "1.000", "c", "Spain"), line("new", "t", "d", 1, D1, "1.000", "c", "Spain")]
    model = stored(spark, tmp_path, "m", first)
    merged = model.add(frame(spark, second))
    assert rows(merged.table("repairs").select("InvoiceNo", "Country")) == [("7", "France")]
    assert merged.table("touched").count() == 2 and merged.table("facts").count() == 301
    assert dict(bag(merged.clean().select("Country"))) == {("France",): 301, ("Spain",): 1}
    assert spark.read.parquet(f"{model.folder}/1/clean").count() == 2


def test_an_addition_that_fails_changes_nothing(spark, tmp_path):
    data, cut = split(35, 200)
    model = stored(spark, tmp_path, "m", data[:cut])
    before = bag(model.clean())
    bad = frame(spark, data[cut:]).withColumn("Country", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        model.add(bad)
    again = StoredRetail(spark, model.folder)
    assert again.version == 0 and bag(again.clean()) == before
    merged = again.add(frame(spark, data[cut:]))
    assert bag(merged.clean()) == bag(stored(spark, tmp_path, "both", data).clean())


def test_loads_need_numbers(spark, tmp_path):
    frame(spark, TINY).drop(ROW_ORDER).write.parquet(str(tmp_path / "t"))
    by_place = read_retail(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="dense"):
        Retail(by_place).store(str(tmp_path / "m")).add(frame(spark, TINY))
    with pytest.raises(ValueError, match="dense"):
        stored(spark, tmp_path, "n", TINY).add(by_place)


def test_stored_counts_read_no_lines(spark, tmp_path):
    model = stored(spark, tmp_path, "m", random_rows(36, 400))
    for analysis in (a.sku_by_country, a.sku_by_region, a.customers_by_country, a.sku_by_country_approx):
        plan = first_plan(analysis(model))
        assert "StockCode" not in plan and "CustomerID" not in plan.replace("CustomerID)", "") or "bucket" in plan or "sketch" in plan
        assert "clean" not in analysis(model)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("analysis", [a.hist_lines_region, a.hist_invoices_country], ids=lambda f: f.__name__)
def test_stored_histograms_scan_once(spark, tmp_path, analysis):
    data = random_rows(37, 600)
    model = stored(spark, tmp_path, "m", data)
    plan = analysis(model)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "bigint" in x.split("ReadSchema")[1]]
    assert len(scans) == 1 and "InvoiceNo" not in plan
    assert rows(analysis(model)) and bag(analysis(model)) == bag(analysis(Retail(frame(spark, data))))
    assert bag(analysis(model, dense=True)) == bag(analysis(Retail(frame(spark, data)), dense=True))


def test_known_bounds_of_a_histogram(spark):
    df = spark.createDataFrame([(datetime(2011, 1, d), "g") for d in (3, 4, 9)], "t timestamp_ntz, g string")
    bounds = spark.createDataFrame([(datetime(2011, 1, 3), datetime(2011, 1, 9))], "low timestamp_ntz, high timestamp_ntz")
    assert bag(time_histogram(df, "t", "g", bins=7, bounds=bounds)) == bag(time_histogram(df, "t", "g", bins=7))


# --- distinct counts that merge


def test_bitmaps_of_many_codes(spark):
    df = spark.range(200_000).selectExpr("if(id % 3 = 0, NULL, cast(id % 3 AS STRING)) AS g", "id AS code")
    counts = dict(rows(count_bitmaps(bitmaps(df, "g", "code"), "g")))
    assert counts == {None: 66_667, "1": 66_667, "2": 66_666}
    # Code 0 is NULL.
    assert dict(rows(count_bitmaps(bitmaps(df, "g", "code"), "g", include_null=False)))[None] == 66_666


def test_error_of_sketches(spark):
    """Within four standard errors, for a set, for two halves of it that overlap, and for few values."""
    df = spark.range(300_000).selectExpr("cast(id % 100000 AS STRING) AS v", "id % 2 AS g")
    df = df.unionByName(spark.sql("SELECT cast(NULL AS STRING) AS v, 0L AS g"))
    bound = 4 * 1.04 / 2 ** (LG_K / 2)
    exact = {r.g: r.n for r in df.dropna().groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    whole = dict(rows(estimate_sketches(sketches(df, "g", "v"), "g", include_null=False)))
    loads = sketches(df.where("v < '5'"), "g", "v").unionByName(sketches(df.where("v >= '4' OR v IS NULL"), "g", "v"))
    merged = dict(rows(estimate_sketches(loads, "g", include_null=False)))
    for found in (whole, merged):
        assert all(abs(found[g] - n) <= bound * n for g, n in exact.items())
    nulls = dict(rows(merge_sketches(loads, "g").select("g", "has_null")))
    assert nulls == {0: True, 1: False}
    few = spark.createDataFrame([("g", "a"), ("g", None), ("h", None)], "g string, v string")
    assert dict(rows(estimate_sketches(sketches(few, "g", "v"), "g"))) == {"g": 2, "h": 1}
    assert dict(rows(estimate_sketches(sketches(few, "g", "v"), "g", False))) == {"g": 1, "h": 0}


def test_approximate_reports(spark, tmp_path):
    data, cut = split(38)
    raw, expected = Retail(frame(spark, data)), Brute(data)
    merged = stored(spark, tmp_path, "m", data[:cut]).add(frame(spark, data[cut:]))
    for model in (raw, merged):  # so few values are counted exactly
        assert rows(a.sku_by_country_approx(model)) == expected.variety("Country", "StockCode")
        assert rows(a.sku_by_region_approx(model)) == expected.variety("Region", "StockCode")
        assert rows(a.customers_by_country_approx(model)) == expected.variety("Geo", "CustomerID")


# --- lines set aside


def write_lines(path, lines):
    path.mkdir()
    (path / "a.csv").write_text("\n".join([",".join(["line_no", *RETAIL_SCHEMA.names]), *lines]) + "\n")


def test_bad_lines_are_set_aside(spark, tmp_path):
    good = "1,a,d,3,2011-01-04 10:00:00,2.550,c,UK"
    write_lines(
        tmp_path / "in",
        [
            f"0,{good}", "1,1,a,d,many,2011-01-04 10:00:00,2.550,c,UK", "2,1,a,d,3.5,2011-01-04 10:00:00,2.550,c,UK",
            "3,1,a,d,3,yesterday,2.550,c,UK", "4,1,a,d,3,2011-01-04 10:00:00,2.5555,c,UK", "5,1,a,d,3000000000,,1,c,UK",
            "6,,,,,,,,", "7,1,a", f"x,{good}", f",{good}", f"10,{good},more", "11,1,a,d, 3 ,2011-01-04 10:00:00,2.5500,c,UK",
        ],
    )
    found = load_checked(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv", sequence="line_no")
    assert found.lines.columns == [*RETAIL_SCHEMA.names, ROW_ORDER]
    assert [f.dataType for f in found.lines.schema][:-1] == [f.dataType for f in RETAIL_SCHEMA]
    kept = {r[ROW_ORDER]: r for r in found.lines.collect()}
    assert kept.keys() == {0, 6, 11} and kept[0].UnitPrice == Decimal("2.550") == kept[11].UnitPrice
    assert kept[6].Quantity is None and kept[11].Quantity == 3
    reasons = {r[ROW_ORDER]: r for r in found.rejects.where("row_order IS NOT NULL").collect()}
    assert {k: r.reason for k, r in reasons.items()} == {
        1: "Quantity: not int: many", 2: "Quantity: not int: 3.5", 3: "InvoiceDate: not timestamp_ntz: yesterday",
        4: "UnitPrice: not decimal(12,3): 2.5555", 5: "Quantity: not int: 3000000000",
        7: "malformed line", 10: "malformed line",
    }
    assert json.loads(reasons[1].source)["Quantity"] == "many" and reasons[7].source == "7,1,a"
    unnumbered = Counter(r.reason for r in found.rejects.where("row_order IS NULL").collect())
    assert unnumbered == {"line_no: not bigint: x": 1, "line_no: missing": 1}
    assert found.lines.count() + found.rejects.count() == 12


def test_lines_are_read_once(spark, tmp_path):
    write_lines(tmp_path / "in", [f"{i},1,a,d,{'x' if i % 5 == 0 else 1},2011-01-04 10:00:00,1.0,c,UK" for i in range(40)])
    plan = check_lines(spark, str(tmp_path / "in"), "csv", "line_no")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    plain = [f"1,a,d,{'x' if i % 5 == 0 else 1},2011-01-04 10:00:00,1.0,c,UK" for i in range(40)]
    (tmp_path / "b.csv").write_text("\n".join([",".join(RETAIL_SCHEMA.names), *plain]) + "\n")
    by_place = load_checked(spark, str(tmp_path / "b.csv"), str(tmp_path / "out"), "csv")
    assert (by_place.lines.count(), by_place.rejects.count()) == (32, 8)
    assert Retail(by_place.lines).clean().count() == 32


def test_other_types_and_formats_are_checked(spark, tmp_path):
    kinds = {"Quantity": "double", "CustomerID": "double", "UnitPrice": "string"}
    schema = ", ".join(f"{f.name} {kinds.get(f.name, f.dataType.simpleString())}" for f in RETAIL_SCHEMA)
    data = [("1", "s", "d", 3.0, D1, "2.5", 17850.0, "UK"), ("2", "s", "d", 3.5, D1, "2.5", 1.5, "UK"),
            ("3", "s", None, None, None, None, None, None), ("4", "s", "d", 1.0, D1, "dear", 1.0, "UK")]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "p"))
    found = load_checked(spark, str(tmp_path / "p"), str(tmp_path / "o"))
    assert sorted(r.CustomerID or "" for r in found.lines.collect()) == ["", "17850"]
    assert sorted(r.reason for r in found.rejects.collect()) == ["Quantity: not int: 3.5", "UnitPrice: not decimal(12,3): dear"]
    none = load_checked(spark, str(tmp_path / "p"), str(tmp_path / "o2"))
    assert none.lines.where("InvoiceNo = '9'").count() == 0
    write_lines(tmp_path / "in", ["0,1,a,d,3,1/4/2011 10:00,2.5,c,UK", "1,1,a,d,3,2011-01-04,2.5,c,UK"])
    timed = load_checked(spark, str(tmp_path / "in"), str(tmp_path / "o3"), "csv", "line_no", "M/d/yyyy H:mm")
    assert [r.InvoiceDate for r in timed.lines.collect()] == [datetime(2011, 1, 4, 10)]
    assert timed.rejects.count() == 1
    with pytest.raises(ValueError, match="no such column"):
        check_lines(spark, str(tmp_path / "p"), sequence="line_no")
    with pytest.raises(ValueError, match="unknown format"):
        check_lines(spark, str(tmp_path / "p"), "xlsx")


# --- classification


def test_classification_by_table(spark):
    rng = random.Random(39)
    table = [(rng.choice([None, *range(5)]), rng.choice([None, *map(str, range(50))]), rng.choice(["a", "b", None])) for _ in range(400)]
    table += table[:50]
    df = spark.createDataFrame([(v,) for v in [None, "none", *map(str, range(50))] * 3], "x string")
    first = {}
    for b, v, label in sorted((r for r in table if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[2] is None, r[2] or "")):
        first.setdefault(v, label)
    frame_ = spark.createDataFrame(table, "branch bigint, value string, label string")
    got = classify_by_table(df, "x", frame_, "class", "other")
    assert got.columns == ["x", "class"]
    assert bag(got) == Counter((r.x, first.get(r.x, "other")) for r in df.collect())
    assert bag(classify_by_table(df, "x", frame_.limit(0), "class")) == Counter((r.x, None) for r in df.collect())


def test_a_large_classification(spark):
    """100,000 values, each in two branches: the plan doesn't grow with them."""
    table = spark.range(200_000).selectExpr("id DIV 100000 AS branch", "cast(id % 100000 AS STRING) AS value",
                                            "concat('label ', id DIV 1000) AS label")
    df = spark.range(300_000).selectExpr("if(id % 3 = 0, '7', cast(id AS STRING)) AS x")
    assert first_branches(table).count() == 100_000
    got = classify_by_table(df, "x", table, "class")
    assert len(final_plan(got)) < 20_000
    assert got.where("class IS NOT NULL").count() == sum(i % 3 == 0 or i < 100_000 for i in range(300_000))
    assert got.where("x = '7' AND class = 'label 0'").count() == 100_001


def test_regions_as_a_table(spark):
    lines = frame(spark, random_rows(40, 300))
    table = branches(spark, REGIONS)
    assert bag(classify_by_table(lines, "Country", table, "Region")) == bag(a.with_region(lines))


# --- names


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
    return row[-1]


def brute_names(names, places):
    """The one closest place by comparing all, and the distance."""
    fold = lambda s: " ".join(s.lower().split())
    out = {}
    folded = [(p, fold(p)) for p in places]
    for name in names:
        f, best = fold(name), {}
        for p, g in folded:
            n = max(len(f), len(g))
            allowed = 0 if n < 3 else 1 if n < 6 else 2
            if f and g and abs(len(f) - len(g)) <= allowed and (d := distance(f, g)) <= allowed:
                best.setdefault(0 if name == p else d + 1, []).append((p, d))
        if best and len(best[min(best)]) == 1:
            out[name] = best[min(best)][0]
    return out


def misspelt(rng, word):
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(word) + 1)
        word = word[:at] + rng.choice(["", "x", "a", " ", "É"]) + word[at + rng.randrange(2) :]
    return word.upper() if rng.random() < 0.1 else word


def test_closest_names(spark):
    rng = random.Random(41)
    letters = "abcdeé "
    places = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(250)} | {"aaaaaa", "Aaaaaa", "", " "}
    names = {misspelt(rng, rng.choice(sorted(places))) for _ in range(1200)} | {"aaaaaaaa", "abaaba", ""}
    left = spark.createDataFrame([(n,) for n in [*names, None]], "who string")
    right = spark.createDataFrame([(p,) for p in [*places, None]], "place string")
    got = closest_names(left, "who", right, "place")
    assert {r.who: (r.match, r.distance) for r in got.collect()} == brute_names(names, places)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_five_thousand_names(spark):
    """Long names against a gazetteer of 5,000, by the same brute force over those of like length."""
    rng = random.Random(42)
    syllables = ["ka", "to", "ren", "li", "os", "ville", "burg", "san", "mar", "du"]
    places = sorted({" ".join("".join(rng.choices(syllables, k=3)) for _ in range(2)) for _ in range(5000)})
    names = sorted({misspelt(rng, rng.choice(places)) for _ in range(60)})
    left = spark.createDataFrame([(n,) for n in names], "who string")
    right = spark.createDataFrame([(p,) for p in places], "place string")
    got = {r.who: (r.match, r.distance) for r in closest_names(left, "who", right, "place").collect()}
    assert got == brute_names(names, places)


def test_forgiving_lookup(spark):
    df = spark.createDataFrame([("Frence", 1), ("Frence", 2), ("Franc", 3), ("UK", 4), ("Uk", 5), ("Chad", 6), (None, 7)], "Country string, n int")
    places = spark.createDataFrame([("France", 1.0, 2.0), ("UK", 3.0, 4.0), ("Chaf", 0.0, 0.0), ("Chae", 0.0, 0.0)], "Country string, lon double, lat double")
    located = locate(df, places, forgiving=True)
    assert located.columns == ["Country", "n", "coord", "source"]
    assert {r.n: r.coord.lon for r in located.collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 3.0, 5: 3.0, 6: None, 7: None}
    looked = fuzzy_lookup(df, places, "Country", "Country")
    assert looked.columns == ["Country", "n", "distance", "lon", "lat"] and looked.count() == 7


def test_allowed_edits(spark):
    got = spark.range(8).select(allowed_edits(F.col("id")))
    assert [r[0] for r in got.collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
