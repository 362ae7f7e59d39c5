"""Map-ready tables: country outlines or points with a measure. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import inner_lookup
from tillroll.operators.ranking import factor_code
from tillroll.plans.analyses import (
    Names,
    country_customers,
    country_products,
    country_sales,
    country_tickets,
    purchases_per_customer,
)
from tillroll.plans.retail import Model
from tillroll.schema import MAP_NAMES
from tillroll.sources.gazetteer import locate


def _outline(boundaries: DataFrame, measure: DataFrame) -> DataFrame:
    """Outlines of the countries that have a measure.

    The measures of all maps come from the same invoices, so they hold the same
    countries: those with sales.
    """
    return inner_lookup(boundaries, measure, {"region": "Country"})


def map_total_sales(retail: Model, boundaries: DataFrame, names: Names = MAP_NAMES) -> DataFrame:
    return _outline(boundaries, country_sales(retail, names))


def map_avg_ticket(retail: Model, boundaries: DataFrame, names: Names = MAP_NAMES) -> DataFrame:
    return _outline(boundaries, country_tickets(retail, names))


def _coded_outline(boundaries: DataFrame, counts: DataFrame) -> DataFrame:
    # Codes number the counts on the map, so countries without an outline go first.
    # An inner join with the distinct names, not a semi-join: Spark would push that
    # below the count, and the two uses of ``drawn`` would no longer share the count.
    drawn = inner_lookup(counts, boundaries.select("region").distinct(), {"Country": "region"})
    return _outline(boundaries, factor_code(drawn, "n", "n_code", few=True))


def map_customers(retail: Model, boundaries: DataFrame, names: Names = MAP_NAMES) -> DataFrame:
    return _coded_outline(boundaries, country_customers(retail, names))


def map_products(retail: Model, boundaries: DataFrame, names: Names = MAP_NAMES) -> DataFrame:
    return _coded_outline(boundaries, country_products(retail, names))


def point_series(measure: DataFrame, column: str, gazetteer: DataFrame) -> DataFrame:
    """Country, lon, lat, measure, source: the points of a bubble map."""
    located = locate(measure, gazetteer)
    return located.select(
        "Country",
        F.col("coord.lon").alias("lon"),
        F.col("coord.lat").alias("lat"),
        F.col(column).cast("double").alias("measure"),
        "source",
    )


# Measure name -> frame of Country and measure, and the measure's column.
POINT_MEASURES = {
    "products": (country_products, "n"),
    "avg_ticket": (country_tickets, "venta_promedio"),
    "customers": (country_customers, "n"),
    "total_sales": (country_sales, "total_invoice"),
}


def geo_point_series(
    retail: Model, gazetteer: DataFrame, measure: str, names: Names = MAP_NAMES
) -> DataFrame:
    frame, column = POINT_MEASURES[measure]
    return point_series(frame(retail, names), column, gazetteer)


def customer_scatter_series(retail: Model) -> DataFrame:
    """Customer and number of purchases: the points of a scatter chart."""
    return purchases_per_customer(retail).select("CustomerID", "n")
