"""Invoice lines, outlines and coordinates derived from the star-schema tables.

The test tables have no NULLs and no dirty rows, so the derivation makes some:
returns, free items, unknown customers, and products and invoices whose lines
disagree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.expressions import recode
from tillroll.plans.retail import Retail
from tillroll.schema import RETAIL_SCHEMA, ROW_ORDER
from tillroll.session import scratch_folder

# NATION_24 is in no region.
REGIONS = {
    "North": [f"NATION_{i}" for i in range(0, 5)],
    "South": [f"NATION_{i}" for i in range(5, 10)],
    "East": [f"NATION_{i}" for i in range(10, 15)],
    "West": [f"NATION_{i}" for i in range(15, 20)],
    "Center": [f"NATION_{i}" for i in range(20, 24)],
}

# Two sources share a target.
MAP_NAMES = {
    "NATION_0": "LAND_A",
    "NATION_1": "LAND_A",
    "NATION_2": "LAND_B",
    "NATION_3": "LAND_C",
    "NATION_4": "LAND_D",
}

SKUS = ("SMALL RING-BRAND#2", "RED WIDGET-BRAND#17", "BLUE BOLT-BRAND#4")

NO_OUTLINE = ("NATION_22", "NATION_23")
NO_COORDINATE = ("NATION_20", "NATION_24")

# Unique over the lines, which (order, line number) is not.
LINE_ORDER = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "l_extendedprice",
    "l_quantity",
)


# Eight lines of a thousand million orders times it stay within a BIGINT.
LINE_STRIDE = 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_raw(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Invoice lines with a row order.

    ``columns`` limits the work to the attributes a query reads: tables that hold
    none of them are not joined, and what would come from those is left out, so
    that a query that does read it fails. Each joined table is unique on its key, so
    the lines stay the same.
    """
    wanted = set(columns) or set(RETAIL_SCHEMA.names)
    lines = table(spark, sf_dir, "lineitem")
    derived = {
        "InvoiceNo": F.expr("cast(l_orderkey AS STRING)"),
        "Quantity": F.expr(
            "if(l_returnflag = 'R', -cast(l_quantity AS INT), cast(l_quantity AS INT))"
        ),
        "InvoiceDate": F.col("l_shipdate"),
        # Whole thousandths, so that no double is rounded.
        "UnitPrice": F.expr(
            "cast(cast(if(l_tax = 0, 0L, cast(rint(l_extendedprice * 100) AS BIGINT) * 10"
            " div cast(l_quantity AS INT)) AS DECIMAL(14, 0)) * 0.001BD AS DECIMAL(12, 3))"
        ),
    }
    if "CustomerID" in wanted:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        derived["CustomerID"] = F.expr("if(o_custkey % 10 = 0, NULL, cast(o_custkey AS STRING))")
    if wanted & {"StockCode", "Description"}:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        derived["StockCode"] = F.expr("lower(concat(p_name, '-', p_brand))")
        derived["Description"] = F.col("p_type")
    if "Country" in wanted:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        lines = lines.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        derived["Country"] = F.col("n_name")
    return lines.select(
        *[derived[f.name].cast(f.dataType).alias(f.name) for f in RETAIL_SCHEMA if f.name in derived],
        F.struct(*LINE_ORDER).alias(ROW_ORDER),
    )


def retail(spark: SparkSession, sf_dir: str, *columns: str) -> Retail:
    return Retail(retail_raw(spark, sf_dir, *columns))


def written(df: DataFrame, fmt: str = "parquet") -> str:
    """The path of a copy of ``df`` below the shared folder, for a reader to read."""
    path = f"{scratch_folder(df.sparkSession)}/{fmt}-{uuid.uuid4().hex}"
    df.write.option("header", True).format(fmt).save(path)
    return path


def numbered_raw(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Invoice lines whose first column, ``line_no``, is a number of their own.

    Lines come by order and line; lines of one number there are told apart by part,
    supplier and price.
    """
    raw = retail_raw(spark, sf_dir)
    within = "l_partkey * 1000003 + l_suppkey * 7919 + cast(rint(l_extendedprice * 100) AS BIGINT)"
    number = F.expr(f"(l_orderkey * 8 + l_linenumber) * {LINE_STRIDE} + ({within}) % {LINE_STRIDE}")
    lines = raw.select(f"{ROW_ORDER}.*", *RETAIL_SCHEMA.names)
    return lines.select(number.alias("line_no"), *RETAIL_SCHEMA.names, *more)


# Parts whose lines come with a second load.
SECOND_LOAD = "l_partkey % 3 = 0"


def two_loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbered lines in two loads; most invoices have lines in both."""
    raw = numbered_raw(spark, sf_dir, F.expr(SECOND_LOAD).alias("second"))
    return tuple(raw.where(F.col("second") == second).drop("second") for second in (False, True))


# Every so many lines have a value that does not fit.
BAD_QUANTITY, BAD_PRICE, BAD_DATE = 97, 101, 103


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines as strings, some with a quantity, price or date that does not fit its type."""
    raw = numbered_raw(spark, sf_dir)
    strings = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    bad = lambda column, every, value: F.when(F.col("line_no").cast("bigint") % every == 0, value).otherwise(F.col(column))
    return strings.withColumns(
        {
            "Quantity": bad("Quantity", BAD_QUANTITY, "many"),
            "UnitPrice": bad("UnitPrice", BAD_PRICE, "1.2345"),
            "InvoiceDate": bad("InvoiceDate", BAD_DATE, "yesterday"),
        }
    )


def misspelt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part's name as ``Country``: as it is, in capitals, a character short or one too many."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    at = "cast(l_orderkey % length(p_name) AS INT)"
    return named.select(
        F.expr(
            f"CASE l_orderkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)"
            f" WHEN 2 THEN concat(substring(p_name, 1, {at}), substring(p_name, {at} + 2))"
            f" ELSE concat(substring(p_name, 1, {at}), 'q', substring(p_name, {at} + 1)) END"
        ).alias("Country")
    )


def part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up coordinate for the name of every part."""
    part = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return part.selectExpr("p_name AS Country", "cast(k % 360 - 180 AS DOUBLE) AS lon", "cast(k % 180 - 90 AS DOUBLE) AS lat")


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch, value, label): every customer in the branch of its nation, and all again in branch 12."""
    customer = table(spark, sf_dir, "customer")
    own = customer.selectExpr("cast(c_nationkey AS BIGINT) AS branch", "cast(c_custkey AS STRING) AS value", "c_mktsegment AS label")
    return own.unionByName(own.withColumns({"branch": F.lit(12).cast("bigint"), "label": F.lit("LATE")}))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per supplier under the map name of its nation; some names missing, some unknown."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    outlines = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .where(~F.col("n_name").isin(*NO_OUTLINE))
        .withColumn("region", F.expr("if(s_suppkey % 25 = 7, 'NOWHERE', n_name)"))
    )
    vertices = recode(outlines, "region", MAP_NAMES).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.lit(3)))
    )
    return vertices.selectExpr(
        "cast(s_suppkey % 36 * 10 - 180 + v % 2 AS DOUBLE) AS long",
        "cast(s_suppkey % 17 * 10 - 80 + v div 2 AS DOUBLE) AS lat",
        "cast(s_suppkey AS INT) AS group",
        "v AS order",
        "region",
        "if(s_suppkey % 3 = 0, 'Isle', NULL) AS subregion",
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate per map name, two names missing."""
    nation = table(spark, sf_dir, "nation").where(~F.col("n_name").isin(*NO_COORDINATE))
    named = recode(nation.withColumnRenamed("n_name", "Country"), "Country", MAP_NAMES)
    keys = named.groupBy("Country").agg(F.min("n_nationkey").alias("k"))
    return keys.selectExpr(
        "Country", "cast(k * 7 - 90 AS DOUBLE) AS lon", "cast(k * 3 - 40 AS DOUBLE) AS lat"
    )
