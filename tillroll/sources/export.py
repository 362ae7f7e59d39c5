"""Export of the sales per country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ranking import descending

# Fixed value: the header of the amounts in the export.
EXPORT_MEASURE = "Ventas Totales"


def country_sales_export(sales: DataFrame) -> DataFrame:
    """Country and its sales under the export's header, from high to low."""
    renamed = sales.select("Country", F.col("total_invoice").alias(EXPORT_MEASURE))
    return descending(renamed, EXPORT_MEASURE, "Country")


def write_country_sales(sales: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the export as CSV with a header.

    Amounts are written in plain notation without trailing zeros. Part files are
    in sort order; adaptive execution merges a result of report size into one.
    """
    plain = F.regexp_replace(F.col(EXPORT_MEASURE).cast("decimal(33,3)").cast("string"), r"\.?0+$", "")
    rows = country_sales_export(sales)
    rows.withColumn(EXPORT_MEASURE, plain).write.mode(mode).option("header", True).csv(path)
