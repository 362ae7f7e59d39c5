"""Retail sales analytics on Spark DataFrames."""

from tillroll.plans.retail import Retail, StoredRetail
from tillroll.sources.boundaries import read_boundaries
from tillroll.sources.export import country_sales_export, write_country_sales
from tillroll.sources.gazetteer import locate, read_gazetteer
from tillroll.sources.retail import load_checked, read_retail

__all__ = [
    "Retail",
    "StoredRetail",
    "country_sales_export",
    "load_checked",
    "locate",
    "read_boundaries",
    "read_gazetteer",
    "read_retail",
    "write_country_sales",
]
