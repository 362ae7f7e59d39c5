"""Country coordinates from a table; no service is called."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.fuzzy import fuzzy_lookup
from tillroll.operators.joins import left_lookup, require_unique
from tillroll.schema import GAZETTEER_SCHEMA, require_schema


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Country, lon, lat; fails if a country comes twice, which would repeat what is looked up."""
    return require_unique(require_schema(spark.read.parquet(path), GAZETTEER_SCHEMA), "Country")


def locate(
    df: DataFrame, gazetteer: DataFrame, source: str = "gazetteer", forgiving: bool = False
) -> DataFrame:
    """Add the nested column ``coord`` (lon, lat) and the label ``source``.

    A country the gazetteer does not hold gets a NULL lon and lat. ``forgiving`` looks up
    the one closest name (``operators.fuzzy``).
    """
    places = gazetteer.select("Country", "lon", "lat")
    located = fuzzy_lookup(df, places, "Country", "Country") if forgiving else left_lookup(df, places, "Country")
    return located.select(
        *df.columns, F.struct("lon", "lat").alias("coord"), F.lit(source).alias("source")
    )
