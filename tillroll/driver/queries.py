"""One query per operator and analysis, over the derived retail tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.driver.adapter import (
    MAP_NAMES,
    REGIONS,
    SKUS,
    boundaries,
    customer_segments,
    dirty_raw,
    gazetteer,
    misspelt_parts,
    numbered_raw,
    part_places,
    retail,
    retail_raw,
    table,
    two_loads,
    written,
)
from tillroll.functions.expressions import is_in, line_total, recode, round_half_even
from tillroll.operators.aggregates import count_by, sum_by
from tillroll.operators.classification import branches, classify_by_table
from tillroll.operators.joins import keep_matching, left_lookup, natural_left_join
from tillroll.operators.keyed import distinct_rows
from tillroll.operators.ranking import descending, factor_code, share_of_total, top_n
from tillroll.operators.variety import LG_K
from tillroll.plans import analyses, maps
from tillroll.plans.retail import Retail, upper_codes
from tillroll.schema import INVOICE_COLUMNS, RETAIL_SCHEMA, ROW_ORDER
from tillroll.session import at_once, scratch_folder
from tillroll.sources.boundaries import read_boundaries
from tillroll.sources.export import EXPORT_MEASURE, country_sales_export, write_country_sales
from tillroll.sources.gazetteer import locate, read_gazetteer
from tillroll.sources.retail import load_checked, read_retail

Query = Callable[[SparkSession, str], DataFrame]

SALES = ("Country",)
SKU = ("StockCode", "Country")


def _report(df: DataFrame) -> DataFrame:
    """Show decimals as doubles, as reports do."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else f.name
            for f in df.schema
        ]
    )


# Scans, projections and filters


def scan_retail(spark, sf):
    """Written as Parquet and read back in the order of the files."""
    path = written(retail_raw(spark, sf).drop(ROW_ORDER))
    return _report(read_retail(spark, path).select(*RETAIL_SCHEMA.names))


def _numbered(spark, sf, fmt="parquet"):
    return read_retail(spark, written(numbered_raw(spark, sf), fmt), fmt, sequence="line_no")


def scan_retail_csv(spark, sf):
    return _report(_numbered(spark, sf, "csv").select(*RETAIL_SCHEMA.names))


def scan_retail_converted(spark, sf):
    """Prices written as doubles, quantities as BIGINT, invoice numbers as doubles."""
    other = {"UnitPrice": "double", "Quantity": "bigint", "InvoiceNo": "double"}
    raw = numbered_raw(spark, sf).withColumns({c: F.col(c).cast(t) for c, t in other.items()})
    lines = read_retail(spark, written(raw), sequence="line_no", convert=True)
    return _report(lines.select(*RETAIL_SCHEMA.names))


def scan_retail_dense(spark, sf):
    """Numbers of the lines of several files, five for each split of the input.

    They are dealt by line, as a product may hold most of them.
    """
    files = 5 * table(spark, sf, "lineitem").rdd.getNumPartitions()
    path = written(retail_raw(spark, sf).drop(ROW_ORDER).repartition(files, *RETAIL_SCHEMA.names))
    number = F.col(ROW_ORDER)
    return read_retail(spark, path, dense=True).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_distinct(number).alias("different"),
    )


def _checked(spark, sf):
    folder = f"{scratch_folder(spark)}/checked-{uuid.uuid4().hex}"
    return load_checked(spark, written(dirty_raw(spark, sf), "csv"), folder, "csv", sequence="line_no")


def scan_retail_good(spark, sf):
    return _report(_checked(spark, sf).lines)


def scan_retail_rejects(spark, sf):
    rejects = _checked(spark, sf).rejects
    quantity = F.get_json_object("source", "$.Quantity").alias("quantity")
    return rejects.select(F.col(ROW_ORDER).alias("line_no"), "reason", quantity)


def project_upper(spark, sf):
    return upper_codes(retail_raw(spark, sf, "StockCode")).select("InvoiceNo", "StockCode")


def project_lines(spark, sf):
    return _report(retail(spark, sf, "StockCode").invoice_lines())


def project_total(spark, sf):
    lines = retail(spark, sf, "StockCode").lines
    return _report(lines.select("InvoiceNo", "StockCode", line_total().alias("Total")))


def classify_region(spark, sf):
    lines = analyses.with_region(retail_raw(spark, sf, "Country"), REGIONS)
    return lines.select("InvoiceNo", "Country", "Region")


def classify_region_table(spark, sf):
    """The regions as a table, with a later branch that claims all countries again."""
    everything = [c for countries in REGIONS.values() for c in countries]
    groups = branches(spark, REGIONS | {"Anywhere": everything})
    lines = classify_by_table(retail_raw(spark, sf, "Country"), "Country", groups, "Region")
    return lines.select("InvoiceNo", "Country", "Region")


def classify_customer_table(spark, sf):
    lines = retail_raw(spark, sf, "CustomerID").select("InvoiceNo", "CustomerID")
    return classify_by_table(lines, "CustomerID", customer_segments(spark, sf), "Segment", "unknown")


def normalize_country(spark, sf):
    return recode(retail_raw(spark, sf, "Country"), "Country", MAP_NAMES).select("InvoiceNo", "Country")


def filter_valid_lines(spark, sf):
    return _report(retail(spark, sf).lines.select(*RETAIL_SCHEMA.names))


def filter_in_list(spark, sf):
    lines = retail(spark, sf, "StockCode").invoice_lines()
    return _report(lines.where(is_in("StockCode", SKUS)))


def filter_not_null(spark, sf):
    lines = retail_raw(spark, sf, "CustomerID").select("InvoiceNo", "CustomerID")
    return lines.where(F.col("CustomerID").isNotNull())


def round_half_even_query(spark, sf):
    tickets = analyses.country_tickets(retail(spark, sf, *SALES), MAP_NAMES)
    return tickets.select("Country", round_half_even("venta_promedio").alias("venta_promedio"))


# Relations and joins


def distinct_multi(spark, sf):
    return distinct_rows(retail(spark, sf, *INVOICE_COLUMNS).lines, "InvoiceNo", *INVOICE_COLUMNS)


def normalize_invoices(spark, sf):
    return retail(spark, sf, *INVOICE_COLUMNS).invoices()


def normalize_products(spark, sf):
    return retail(spark, sf, "StockCode", "Description").products()


def join_invoices(spark, sf):
    model = retail(spark, sf, "StockCode", *INVOICE_COLUMNS)
    return _report(left_lookup(model.invoice_lines(), model.invoices(), "InvoiceNo"))


def join_products(spark, sf):
    model = retail(spark, sf, "StockCode", "Description")
    return _report(left_lookup(model.invoice_lines(), model.products(), "StockCode"))


def join_null_safe(spark, sf):
    """Every tenth invoice number is lost, so that its lines share the NULL key."""
    raw = retail_raw(spark, sf, "StockCode", *INVOICE_COLUMNS)
    lost = F.col("InvoiceNo").cast("bigint") % 10 == 0
    raw = raw.withColumn("InvoiceNo", F.when(~lost, F.col("InvoiceNo")))
    model = Retail(raw)
    return _report(left_lookup(model.invoice_lines(), model.invoices(), "InvoiceNo"))


def join_natural(spark, sf):
    model = retail(spark, sf, "StockCode", *INVOICE_COLUMNS)
    return _report(natural_left_join(model.invoice_lines(), model.invoices()))


def join_boundaries(spark, sf):
    sales = analyses.country_sales(retail(spark, sf, *SALES), MAP_NAMES)
    return left_lookup(boundaries(spark, sf), sales, {"region": "Country"})


def semi_join_boundaries(spark, sf):
    """Outlines of the countries with sales."""
    sold = analyses.country_sales(retail(spark, sf, *SALES), MAP_NAMES).select("Country")
    return keep_matching(boundaries(spark, sf), sold, {"region": "Country"})


def clean_retail(spark, sf):
    return _report(retail(spark, sf).clean())


def clean_retail_numbered(spark, sf):
    """The cleaned table where the input numbers its lines."""
    return _report(Retail(_numbered(spark, sf)).clean())


def invoices_csv(spark, sf):
    return Retail(_numbered(spark, sf, "csv")).invoices()


def _stored(analysis) -> Query:
    """An analysis of the model that ``store`` writes."""

    def query(spark, sf):
        model = Retail(_numbered(spark, sf))
        return analysis(model.store(f"{scratch_folder(spark)}/retail-{uuid.uuid4().hex}"))

    return query


def _merged(analysis) -> Query:
    """An analysis of a model of a first load to which a second one was added."""

    def query(spark, sf):
        paths = at_once(spark, *[partial(written, load) for load in two_loads(spark, sf)])
        first, second = (read_retail(spark, path, sequence="line_no") for path in paths)
        model = Retail(first).store(f"{scratch_folder(spark)}/retail-{uuid.uuid4().hex}")
        return analysis(model.add(second))

    return query


def _close(exact: DataFrame, estimates: DataFrame, key: str) -> DataFrame:
    """Exact counts, and whether the estimates are within four standard errors."""
    joined = left_lookup(exact, estimates.withColumnRenamed("n", "estimate"), key)
    error = F.abs(F.col("estimate") - F.col("n")) / F.col("n")
    return joined.select(key, "n", (error <= 4 * 1.04 / 2 ** (LG_K / 2)).alias("close"))


def _approximate(model) -> DataFrame:
    return _close(analyses.sku_by_country(model), analyses.sku_by_country_approx(model), "Country")


def sku_by_region_approx(spark, sf):
    model = retail(spark, sf, *SKU)
    exact, estimates = (f(model, REGIONS) for f in (analyses.sku_by_region, analyses.sku_by_region_approx))
    return _close(exact, estimates, "Region")


def geocode_forgiving(spark, sf):
    """Names of parts as they stand on the lines, looked up among the parts' names."""
    names = count_by(misspelt_parts(spark, sf), "Country")
    located = locate(names, part_places(spark, sf), forgiving=True)
    return located.select("Country", "n", "coord.lon", "coord.lat", "source")


def geocode_join(spark, sf):
    sales = analyses.country_sales(retail(spark, sf, *SALES), MAP_NAMES)
    located = locate(sales, read_gazetteer(spark, written(gazetteer(spark, sf))))
    return located.select("Country", "total_invoice", "coord.lon", "coord.lat", "source")


# Shares, codes and limits


def share_of_total_query(spark, sf):
    lines = retail(spark, sf, "StockCode").lines
    return _report(share_of_total(sum_by(lines, "StockCode", line_total(), "total"), "total"))


def factor_code_query(spark, sf):
    purchases = count_by(retail(spark, sf, "CustomerID").facts("CustomerID"), "CustomerID")
    return factor_code(purchases, "n", "n_code")


def limit_print(spark, sf):
    return analyses.products_by_country(retail(spark, sf, *SKU), MAP_NAMES).limit(22)


def top_n_sku_region(spark, sf):
    lines = analyses.with_region(retail(spark, sf, *SKU).sku_lines(), REGIONS)
    counts = count_by(lines, "Region", "StockCode").withColumnRenamed("n", "unidades")
    return top_n(counts, 22, "unidades", "Region", "StockCode")


def export_country_sales(spark, sf):
    return country_sales_export(analyses.country_sales(retail(spark, sf, *SALES), MAP_NAMES))


def export_country_sales_csv(spark, sf):
    """The written CSV, read back."""
    path = f"{scratch_folder(spark)}/export-{uuid.uuid4().hex}"
    write_country_sales(analyses.country_sales(retail(spark, sf, *SALES), MAP_NAMES), path)
    return spark.read.schema(f"Country string, `{EXPORT_MEASURE}` double").csv(path, header=True)


def scan_boundaries(spark, sf):
    return read_boundaries(spark, written(boundaries(spark, sf)))


# Analyses and maps: the attributes read, and the analysis of a model.


def _analysis(function, *args, **kwargs):
    return lambda model, spark, sf: function(model, *args, **kwargs)


def _map(function):
    return lambda model, spark, sf: function(model, boundaries(spark, sf), MAP_NAMES)


def _points(measure):
    return lambda model, spark, sf: maps.geo_point_series(
        model, gazetteer(spark, sf), measure, MAP_NAMES
    )


CUSTOMER = ("CustomerID",)
CUSTOMER_COUNTRY = ("CustomerID", "Country")

ANALYSES = {
    "purchases_per_customer": (CUSTOMER, _analysis(analyses.purchases_per_customer)),
    "mean_purchases": (CUSTOMER, _analysis(analyses.mean_purchases)),
    "list_countries": (SALES, _analysis(analyses.list_countries)),
    "hist_invoices_country": (SALES, _analysis(analyses.hist_invoices_country)),
    "hist_lines_region": (SALES, _analysis(analyses.hist_lines_region, REGIONS)),
    "sales_by_region": (SALES, _analysis(analyses.sales_by_region, REGIONS)),
    "sales_by_country": (SALES, _analysis(analyses.sales_by_country)),
    "price_by_region_sku": (SKU, _analysis(analyses.price_by_region_sku, REGIONS, SKUS)),
    "sku_by_region": (SKU, _analysis(analyses.sku_by_region, REGIONS)),
    "sku_by_country": (SKU, _analysis(analyses.sku_by_country)),
    "geo_sales": (SALES, _analysis(analyses.geo_sales, MAP_NAMES)),
    "avg_ticket_by_country": (SALES, _analysis(analyses.avg_ticket_by_country, MAP_NAMES)),
    "customers_by_country": (CUSTOMER_COUNTRY, _analysis(analyses.customers_by_country, MAP_NAMES)),
    "products_by_country": (SKU, _analysis(analyses.products_by_country, MAP_NAMES)),
    "map_total_sales": (SALES, _map(maps.map_total_sales)),
    "map_avg_ticket": (SALES, _map(maps.map_avg_ticket)),
    "map_customers": (CUSTOMER_COUNTRY, _map(maps.map_customers)),
    "map_products": (SKU, _map(maps.map_products)),
    "geo_point_series": (SKU, _points("products")),
    "geo_point_series_avg_ticket": (SALES, _points("avg_ticket")),
    "geo_point_series_customers": (CUSTOMER_COUNTRY, _points("customers")),
    "geo_point_series_total_sales": (SALES, _points("total_sales")),
    "customer_scatter_series": (CUSTOMER, _analysis(maps.customer_scatter_series)),
    "hist_lines_region_dense": (SALES, _analysis(analyses.hist_lines_region, REGIONS, dense=True)),
}


def _query(columns, analysis) -> Query:
    return lambda spark, sf: analysis(retail(spark, sf, *columns), spark, sf)


OPERATORS: dict[str, Query] = {
    "scan_retail": scan_retail,
    "scan_boundaries": scan_boundaries,
    "geocode_join": geocode_join,
    "limit_print": limit_print,
    "export_country_sales": export_country_sales,
    "project_upper": project_upper,
    "project_lines": project_lines,
    "project_total": project_total,
    "classify_region": classify_region,
    "filter_in_list": filter_in_list,
    "normalize_country": normalize_country,
    "share_of_total": share_of_total_query,
    "factor_code": factor_code_query,
    "filter_not_null": filter_not_null,
    "round_half_even": round_half_even_query,
    "filter_valid_lines": filter_valid_lines,
    "join_invoices": join_invoices,
    "join_products": join_products,
    "join_null_safe": join_null_safe,
    "join_natural": join_natural,
    "join_boundaries": join_boundaries,
    "semi_join_boundaries": semi_join_boundaries,
    "distinct_multi": distinct_multi,
    "normalize_invoices": normalize_invoices,
    "normalize_products": normalize_products,
    "clean_retail": clean_retail,
    "top_n_sku_region": top_n_sku_region,
    "scan_retail_csv": scan_retail_csv,
    "scan_retail_converted": scan_retail_converted,
    "clean_retail_numbered": clean_retail_numbered,
    "invoices_csv": invoices_csv,
    "export_country_sales_csv": export_country_sales_csv,
    "stored_clean": _stored(lambda model: _report(model.clean())),
    "stored_sales_by_country": _stored(analyses.sales_by_country),
    "stored_sku_by_country": _stored(analyses.sku_by_country),
    "stored_sku_by_region": _stored(lambda model: analyses.sku_by_region(model, REGIONS)),
    "stored_customers_by_country": _stored(lambda model: analyses.customers_by_country(model, MAP_NAMES)),
    "stored_hist_lines_region": _stored(lambda model: analyses.hist_lines_region(model, REGIONS)),
    "stored_sku_by_country_approx": _stored(_approximate),
    "sku_by_region_approx": sku_by_region_approx,
    "merged_clean": _merged(lambda model: _report(model.clean())),
    "merged_invoices": _merged(lambda model: model.invoices()),
    "merged_products": _merged(lambda model: model.products()),
    "merged_sales_by_country": _merged(analyses.sales_by_country),
    "merged_sku_by_country": _merged(analyses.sku_by_country),
    "merged_customers_by_country": _merged(lambda model: analyses.customers_by_country(model, MAP_NAMES)),
    "merged_hist_invoices_country": _merged(analyses.hist_invoices_country),
    "merged_sku_by_country_approx": _merged(_approximate),
    "classify_region_table": classify_region_table,
    "classify_customer_table": classify_customer_table,
    "scan_retail_dense": scan_retail_dense,
    "scan_retail_good": scan_retail_good,
    "scan_retail_rejects": scan_retail_rejects,
    "geocode_forgiving": geocode_forgiving,
}

QUERIES: dict[str, Query] = {n: _query(*a) for n, a in ANALYSES.items()} | OPERATORS
