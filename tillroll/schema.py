"""Schemas and reference data of the retail model."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RETAIL_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        # Shop timestamps carry no zone, so no session time zone may shift them.
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DecimalType(12, 3)),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)

BOUNDARY_SCHEMA = T.StructType(
    [
        T.StructField("long", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("group", T.IntegerType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("subregion", T.StringType()),
    ]
)

GAZETTEER_SCHEMA = T.StructType(
    [
        T.StructField("Country", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)

# Position of a line in its input. Any orderable type will do, as long as it is
# never NULL and differs on every line; it defines what "first row" means.
ROW_ORDER = "row_order"

FILE_PATH = "file_path"

INVOICE_COLUMNS = ("InvoiceDate", "CustomerID", "Country")

# Sales region -> source country names.
REGIONS = {
    "Western Europe": [
        "United Kingdom",
        "France",
        "Switzerland",
        "Netherlands",
        "EIRE",
        "Belgium",
        "Channel Islands",
    ],
    "Northern Europe": ["Norway", "Sweden", "Finland", "Iceland", "Denmark"],
    "Central Europe": ["Germany", "Austria", "Czech Republic"],
    "Southern Europe": ["Italy", "Greece", "Cyprus", "Malta", "Spain", "Portugal"],
    "Eastern Europe": ["Poland", "Lithuania"],
    "Middle East": ["Bahrain", "Israel", "Lebanon", "United Arab Emirates", "Saudi Arabia"],
    "East Asia": ["Japan", "Hong Kong", "Singapore"],
    "America": ["Canada", "USA", "Brazil"],
    "Other": ["Unspecified", "European Community", "Australia", "RSA"],
}

# Source country name -> name used by the boundary table.
MAP_NAMES = {
    "United Kingdom": "UK",
    "Channel Islands": "UK",
    "EIRE": "Ireland",
    "RSA": "South Africa",
    "Hong Kong": "China",
}

# The products whose prices are compared between regions.
PRICE_SKUS = ("85123A", "85099B", "22423")


def in_file_order(lines: DataFrame) -> bool:
    """Whether ``row_order`` is a number or a position in a file, as ``read_retail`` makes it."""
    kind = lines.schema[ROW_ORDER].dataType
    return kind.names[0] == FILE_PATH if isinstance(kind, T.StructType) else isinstance(kind, T.NumericType)


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to the columns of ``schema``; fail if one is missing or has another type."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {found[f.name].simpleString() if f.name in found else 'no such column'}"
        for f in schema
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df.select(*schema.names)
