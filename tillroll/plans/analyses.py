"""Named analyses. Each takes a ``Retail`` or ``StoredRetail`` model and returns a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.expressions import classify, exact_mean, is_in, recode
from tillroll.operators.aggregates import (
    count_by,
    mean_by,
    mean_count,
    sum_by,
)
from tillroll.operators.histogram import time_histogram
from tillroll.operators.keyed import distinct_rows
from tillroll.operators.ranking import descending, share_of_total, top_n
from tillroll.plans.retail import Model
from tillroll.schema import MAP_NAMES, PRICE_SKUS, REGIONS

Regions = Mapping[str, Sequence[str]]
Names = Mapping[str, str]


def with_region(df: DataFrame, regions: Regions = REGIONS) -> DataFrame:
    return df.withColumn("Region", classify("Country", regions))


def _as_double(df: DataFrame, measure: str) -> DataFrame:
    return df.withColumn(measure, F.col(measure).cast("double"))


# Customers and time


def purchases_per_customer(retail: Model) -> DataFrame:
    """Invoices per known customer."""
    known = retail.facts("CustomerID").where(F.col("CustomerID").isNotNull())
    return descending(count_by(known, "CustomerID"), "n", "CustomerID")


def mean_purchases(retail: Model, include_null: bool = True) -> DataFrame:
    """Mean number of invoices per customer; unknown customers count as one."""
    invoices = retail.facts("CustomerID")
    if not include_null:
        invoices = invoices.where(F.col("CustomerID").isNotNull())
    return mean_count(count_by(invoices, "CustomerID"))


def list_countries(retail: Model, limit: int | None = None) -> DataFrame:
    """The country names, or the first ``limit`` of them."""
    countries = distinct_rows(retail.facts("Country"), "Country")
    ordered = countries.orderBy(F.asc_nulls_last("Country"))
    return ordered if limit is None else ordered.limit(limit)


def hist_invoices_country(retail: Model, bins: int = 30, dense: bool = False) -> DataFrame:
    """Invoices over time by country."""
    times, bounds = retail.times()
    return time_histogram(times, "InvoiceDate", "Country", "n_invoices", bins, dense, bounds)


def hist_lines_region(
    retail: Model, regions: Regions = REGIONS, bins: int = 30, dense: bool = False
) -> DataFrame:
    """Invoice lines over time by region."""
    times, bounds = retail.times()
    return time_histogram(with_region(times, regions), "InvoiceDate", "Region", "n_lines", bins, dense, bounds)


# Sales and prices


def _sales(invoices: DataFrame, key: str) -> DataFrame:
    sums = sum_by(invoices, key, "total", "total_invoice")
    shares = share_of_total(sums, "total_invoice")
    return descending(_as_double(shares, "total_invoice"), "total_invoice", key)


def sales_by_region(retail: Model, regions: Regions = REGIONS) -> DataFrame:
    return _sales(with_region(retail.facts("Country"), regions), "Region")


def sales_by_country(retail: Model) -> DataFrame:
    return _sales(retail.facts("Country"), "Country")


def price_by_region_sku(
    retail: Model,
    regions: Regions = REGIONS,
    skus: Sequence[str] = PRICE_SKUS,
    limit: int | None = None,
) -> DataFrame:
    """Mean price and number of lines of chosen products in each region; all rows, or the
    first ``limit``."""
    lines = with_region(retail.sku_lines(), regions).where(is_in("StockCode", skus))
    sums = lines.groupBy("Region", "StockCode").agg(
        F.sum("UnitPrice").alias("_price"), F.count(F.lit(1)).alias("unidades")
    )
    prices = sums.select(
        "Region", "StockCode", exact_mean("_price", "unidades").alias("precio_promedio"), "unidades"
    )
    order = ("unidades", "Region", "StockCode")
    return descending(prices, *order) if limit is None else top_n(prices, limit, *order)


def sku_by_region(retail: Model, regions: Regions = REGIONS) -> DataFrame:
    """Different products sold per region."""
    counts = retail.variety("StockCode", lambda df: with_region(df, regions), "Region")
    return descending(counts, "n", "Region")


def sku_by_region_approx(retail: Model, regions: Regions = REGIONS) -> DataFrame:
    """``sku_by_region`` by sketches, with an error of a few hundredths."""
    counts = retail.variety_approx("StockCode", lambda df: with_region(df, regions), "Region")
    return descending(counts, "n", "Region")


def sku_by_country_approx(retail: Model) -> DataFrame:
    """``sku_by_country`` by sketches, with an error of a few hundredths."""
    return descending(retail.variety_approx("StockCode"), "n", "Country")


def customers_by_country_approx(
    retail: Model, names: Names = MAP_NAMES, include_null: bool = True
) -> DataFrame:
    """``customers_by_country`` by sketches, with an error of a few hundredths."""
    renamed = lambda df: recode(df, "Country", names)
    counts = retail.variety_approx("CustomerID", renamed, include_null=include_null)
    return descending(counts, "n", "Country")


def sku_by_country(retail: Model) -> DataFrame:
    """Different products sold per country."""
    return descending(retail.variety("StockCode"), "n", "Country")


# By country, under the names of the boundary table. The frames below are
# unsorted so that the maps can use them; the reports sort them.


def country_sales(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    invoices = recode(retail.facts("Country"), "Country", names)
    return _as_double(sum_by(invoices, "Country", "total", "total_invoice"), "total_invoice")


def country_tickets(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    invoices = recode(retail.facts("Country"), "Country", names)
    return mean_by(invoices, "Country", "total", "venta_promedio")


def country_customers(retail: Model, names: Names = MAP_NAMES, include_null: bool = True) -> DataFrame:
    return retail.variety("CustomerID", lambda df: recode(df, "Country", names), include_null=include_null)


def country_products(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    return retail.variety("StockCode", lambda df: recode(df, "Country", names))


def geo_sales(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    """Total sales per country."""
    return descending(country_sales(retail, names), "total_invoice", "Country")


def avg_ticket_by_country(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    """Mean invoice total per country."""
    return descending(country_tickets(retail, names), "venta_promedio", "Country")


def customers_by_country(
    retail: Model, names: Names = MAP_NAMES, include_null: bool = True
) -> DataFrame:
    """Customers per country; unknown customers count as one."""
    return descending(country_customers(retail, names, include_null), "n", "Country")


def products_by_country(retail: Model, names: Names = MAP_NAMES) -> DataFrame:
    """Different products sold per country."""
    return descending(country_products(retail, names), "n", "Country")
