"""What the plans must look like for tables far larger than these."""

import re
import uuid
from types import SimpleNamespace

import pytest
from data import TINY, frame, random_rows
from pyspark.sql import functions as F

from tillroll import Retail, StoredRetail, read_retail
from tillroll.functions.expressions import line_total
from tillroll.operators.aggregates import sum_by
from tillroll.operators.ranking import share_of_total
from tillroll.plans import analyses as a
from tillroll.plans import maps
from tillroll.plans.retail import repaired_table
from tillroll.schema import BOUNDARY_SCHEMA, ROW_ORDER
from tillroll.session import shared_folder


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def outlines(spark):
    return spark.createDataFrame([(0.0, 0.0, 1, i, "UK", None) for i in range(50)], BOUNDARY_SCHEMA)


def read_columns(plan):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


@pytest.fixture(scope="module")
def stored_lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "t")
    frame(spark, random_rows(11, 2000)).withColumnRenamed(ROW_ORDER, "row_id").coalesce(1).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def model(spark, stored_lines):
    return Retail(read_retail(spark, stored_lines, sequence="row_id"))


INVOICE_LEVEL = [
    a.sales_by_region, a.sales_by_country, a.geo_sales, a.avg_ticket_by_country,
    a.customers_by_country, a.purchases_per_customer, a.mean_purchases,
    a.hist_lines_region, a.hist_invoices_country, a.list_countries,
]


@pytest.mark.parametrize("analysis", INVOICE_LEVEL, ids=lambda f: f.__name__)
def test_invoice_analyses_need_no_join(model, analysis):
    plan = first_plan(analysis(model))
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("analysis", [*INVOICE_LEVEL, a.sku_by_country, a.price_by_region_sku], ids=lambda f: f.__name__)
def test_no_python_no_cross_join_no_global_window(model, analysis):
    plan = first_plan(analysis(model))
    for node in ("Python", "Arrow", "Cartesian", "NestedLoop", "Window"):
        assert node not in plan


WIDER = {
    "clean": lambda m, spark: m.clean(),
    "dense histogram": lambda m, spark: a.hist_lines_region(m, dense=True),
    "share": lambda m, spark: share_of_total(sum_by(m.lines, "StockCode", line_total(), "total"), "total"),
    "total sales": lambda m, spark: maps.map_total_sales(m, outlines(spark)),
    "ticket": lambda m, spark: maps.map_avg_ticket(m, outlines(spark)),
    "customers": lambda m, spark: maps.map_customers(m, outlines(spark)),
    "products": lambda m, spark: maps.map_products(m, outlines(spark)),
}


def test_the_window_pattern_finds_one(spark):
    plan = spark.range(9).selectExpr("row_number() OVER (ORDER BY id) AS n")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[.*\n\W*(Sort.*\n\W*)?Exchange SinglePartition", plan)


@pytest.mark.parametrize("name", WIDER)
def test_no_python_no_pairs_no_window_over_all(model, spark, name):
    plan = WIDER[name](model, spark)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "ArrowEval", "MapInPandas", "MapInArrow", "CartesianProduct"):
        assert node not in plan
    # A window without keys stands on all rows in one partition.
    assert not re.search(r"Window \[.*\n\W*(Sort.*\n\W*)?Exchange SinglePartition", plan)


def test_filters_and_columns_reach_the_scan(model, spark):
    plan = model.facts("Country")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Quantity,0)" in plan and "GreaterThan(UnitPrice,0.000)" in plan
    [columns] = read_columns(_full(model.facts("Country")))
    assert columns == {"InvoiceNo", "Quantity", "UnitPrice", "Country", "row_id"}
    counts = a.purchases_per_customer(model)
    [columns] = read_columns(_full(counts))
    assert columns == {"InvoiceNo", "Quantity", "UnitPrice", "CustomerID", "row_id"}


def _full(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_first_rows_are_aggregated_before_the_shuffle(model):
    plan = model.invoices()._jdf.queryExecution().executedPlan().toString()
    # One shuffle, of a row for each invoice and task.
    assert plan.count("Exchange") == 1
    assert plan.index("functions=[min(") < plan.index("Exchange") < plan.index("partial_min(")


@pytest.mark.parametrize("sequence", ["row_id", None])
def test_products_are_found_without_sorting_the_lines(spark, stored_lines, sequence):
    products = Retail(read_retail(spark, stored_lines, sequence=sequence)).products()
    plan = products._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange"):]
    assert "HashAggregate" in below and "Sort" not in below


@pytest.mark.parametrize("analysis", [a.sales_by_country, a.hist_lines_region], ids=lambda f: f.__name__)
def test_totals_share_the_shuffles_of_the_report(model, analysis):
    assert "ReusedExchange" in final_plan(analysis(model))


@pytest.mark.parametrize("chart", [maps.map_customers, maps.map_products], ids=lambda f: f.__name__)
def test_category_maps_count_once(spark, model, chart):
    plan = final_plan(chart(model, outlines(spark)))
    # The subquery that lists the counts has made them; the map reads its shuffle.
    assert "partial_count(" not in plan and "partial_min(struct(row_order" not in plan
    assert "ReusedExchange" in plan


def test_a_hot_invoice_is_split(spark):
    """A third of all lines belong to one invoice; the join must not give them to one task."""
    rows = spark.range(300000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("InvoiceNo"),
        (F.col("id") % 5000).cast("string").alias("StockCode"),
        F.lit("d").alias("Description"),
        F.lit(1).alias("Quantity"),
        F.expr("TIMESTAMP_NTZ'2011-01-01 00:00:00'").alias("InvoiceDate"),
        F.expr("1.000BD").cast("decimal(12,3)").alias("UnitPrice"),
        F.lit("c").alias("CustomerID"),
        F.concat(F.lit("land"), F.col("id") % 7).alias("Country"),
        F.col("id").alias(ROW_ORDER),
    )
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        report = a.sku_by_country(Retail(rows))
        assert "skew=true" in final_plan(report)
        # All lines of the hot invoice take the country of its first line.
        counts = dict(map(tuple, report.collect()))
        assert counts["land0"] == 5000
        assert "skew=true" in final_plan(Retail(rows).clean().groupBy("Country").count())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_sides_are_broadcast_by_size_and_large_ones_are_not(spark, model):
    assert "BroadcastHashJoin" in final_plan(maps.map_total_sales(model, outlines(spark)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = final_plan(maps.map_total_sales(model, outlines(spark)))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_top_rows_are_found_without_a_full_sort(model):
    assert "TakeOrderedAndProject" in first_plan(a.price_by_region_sku(model, limit=22))


def test_stored_model_reads_without_joins(spark, model, tmp_path):
    stored = model.store(str(tmp_path / uuid.uuid4().hex))
    assert isinstance(stored, StoredRetail)
    for analysis in (*INVOICE_LEVEL, a.sku_by_region, a.products_by_country):
        assert "Join" not in first_plan(analysis(stored))
    [columns] = read_columns(_full(a.sku_by_country(stored)))
    assert columns == {"value", "Country", "bucket", "bitmap"}


def test_repair_shuffles_no_lines_if_little_disagrees(spark, tmp_path):
    model = Retail(frame(spark, TINY + random_rows(4, 100)))
    stored = model.store(str(tmp_path / "s"))
    repairs, products = stored.table("repairs"), stored.products()
    assert 0 < repairs.count() < model.invoices().count()
    repaired = repaired_table(model.lines, repairs, products)
    assert "Exchange hashpartitioning" not in final_plan(repaired)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        again = repaired_table(model.lines, repairs, products)
        assert final_plan(again).count("SortMergeJoin") == 2
        expected = model.clean().select(*again.columns)
        assert sorted(map(str, again.collect())) == sorted(map(str, expected.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_store_uses_the_shared_folder(spark, model):
    stored = model.store()
    assert stored.folder.startswith(shared_folder(spark))
    assert a.sales_by_country(stored).collect() == a.sales_by_country(model).collect()


def test_shared_folder_must_be_named():
    unset = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(unset)
