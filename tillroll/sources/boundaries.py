"""Reader of country outlines."""

from pyspark.sql import DataFrame, SparkSession

from tillroll.schema import BOUNDARY_SCHEMA, require_schema


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices, one row each; ``region`` is the country name."""
    return require_schema(spark.read.parquet(path), BOUNDARY_SCHEMA)
