"""The queries as DuckDB SQL. Each follows the line-level definition of its analysis,
not the plan the Spark side takes."""

from __future__ import annotations

from tillroll.driver.adapter import (
    BAD_DATE,
    BAD_PRICE,
    BAD_QUANTITY,
    LINE_ORDER,
    LINE_STRIDE,
    MAP_NAMES,
    NO_COORDINATE,
    NO_OUTLINE,
    REGIONS,
    SECOND_LOAD,
    SKUS,
)


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


ORDER = ", ".join(LINE_ORDER)
REGION_OF = "CASE " + " ".join(f"WHEN Country IN {_list(c)} THEN '{r}'" for r, c in REGIONS.items()) + " END"


def _renamed(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MAP_NAMES.items()) + f" ELSE {column} END"


RAW = """
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         lower(p_name || '-' || p_brand) AS StockCode,
         p_type AS Description,
         CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INTEGER)
              ELSE CAST(l_quantity AS INTEGER) END AS Quantity,
         l_shipdate AS InvoiceDate,
         CAST(CAST(CASE WHEN l_tax = 0 THEN 0
                        ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * 10
                             // CAST(l_quantity AS INTEGER) END AS DECIMAL(15, 0))
              * CAST(0.001 AS DECIMAL(4, 3)) AS DECIMAL(12, 3)) AS UnitPrice,
         CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS CustomerID,
         n_name AS Country,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
)"""

# Every tenth invoice number is lost.
RAW_LOST = """
raw_lost AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 10 <> 0 THEN InvoiceNo END AS InvoiceNo) FROM raw
)"""


def _relations(raw: str = "raw", order: str = ORDER) -> str:
    return f"""
valid AS (
  SELECT * REPLACE (upper(StockCode) AS StockCode) FROM {raw} WHERE Quantity > 0 AND UnitPrice > 0
),
invoices AS (
  SELECT InvoiceNo, InvoiceDate, CustomerID, Country
  FROM (SELECT *, row_number() OVER (PARTITION BY InvoiceNo ORDER BY {order}) AS rn FROM valid)
  WHERE rn = 1
),
lines AS (SELECT StockCode, Quantity, UnitPrice, InvoiceNo FROM valid),
products AS (
  SELECT StockCode, Description
  FROM (SELECT *, row_number() OVER (PARTITION BY StockCode ORDER BY {order}) AS rn FROM valid)
  WHERE rn = 1
),
clean AS (
  SELECT lines.*, InvoiceDate, CustomerID, Country, Description,
         UnitPrice * Quantity AS Total, {REGION_OF} AS Region
  FROM lines
  LEFT JOIN invoices ON lines.InvoiceNo IS NOT DISTINCT FROM invoices.InvoiceNo
  LEFT JOIN products ON lines.StockCode IS NOT DISTINCT FROM products.StockCode
),
geo AS (SELECT * REPLACE ({_renamed("Country")} AS Country) FROM clean)"""


GEOGRAPHY = f"""
boundaries AS (
  SELECT CAST(k % 36 * 10 - 180 + v % 2 AS DOUBLE) AS long,
         CAST(k % 17 * 10 - 80 + v // 2 AS DOUBLE) AS lat,
         CAST(k AS INTEGER) AS "group", v AS "order", {_renamed("name")} AS region,
         CASE WHEN k % 3 = 0 THEN 'Isle' END AS subregion
  FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 25 = 7 THEN 'NOWHERE' ELSE n_name END AS name
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name NOT IN {_list(NO_OUTLINE)}) outlines
  CROSS JOIN (VALUES (0), (1), (2), (3)) vertices(v)
),
gazetteer AS (
  SELECT Country, CAST(min(k) * 7 - 90 AS DOUBLE) AS lon, CAST(min(k) * 3 - 40 AS DOUBLE) AS lat
  FROM (SELECT n_nationkey AS k, {_renamed("n_name")} AS Country FROM nation
        WHERE n_name NOT IN {_list(NO_COORDINATE)})
  GROUP BY Country
),
geo_sales AS (SELECT Country, CAST(sum(Total) AS DOUBLE) AS total_invoice FROM geo GROUP BY Country),
geo_ticket AS (
  SELECT Country, CAST(sum(venta) AS DOUBLE) / count(*) AS venta_promedio
  FROM (SELECT InvoiceNo, Country, sum(Total) AS venta FROM geo GROUP BY InvoiceNo, Country)
  GROUP BY Country
),
geo_customers AS (
  SELECT Country, count(*) AS n FROM (SELECT DISTINCT CustomerID, Country FROM geo) GROUP BY Country
),
geo_products AS (
  SELECT Country, count(*) AS n FROM (SELECT DISTINCT StockCode, Country FROM geo) GROUP BY Country
)"""


def _sql(select: str, raw_only: bool = False, geography: bool = False, order: str = ORDER) -> str:
    parts = [RAW] if raw_only else [RAW, _relations(order=order)]
    if geography:
        parts.append(GEOGRAPHY)
    return "WITH " + ",".join(parts) + "\n" + select.strip()


def _sales(key: str, order: str = ORDER) -> str:
    return _sql(
        f"""
SELECT {key}, CAST(total AS DOUBLE) AS total_invoice,
       CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS porcentage
FROM (SELECT {key}, sum(Total) AS total FROM clean GROUP BY {key})
ORDER BY total_invoice DESC NULLS LAST, {key} NULLS LAST""",
        order=order,
    )


def _histogram(table: str, category: str, dense: bool = False, order: str = ORDER) -> str:
    groups = f"SELECT DISTINCT {category} FROM binned"
    rows = "SELECT * FROM binned" if not dense else f"""
  SELECT g.{category}, b.bin, coalesce(binned.n, 0) AS n
  FROM ({groups}) g CROSS JOIN (SELECT unnest(range(1, 31)) AS bin) b
  LEFT JOIN binned ON binned.bin = b.bin AND binned.{category} IS NOT DISTINCT FROM g.{category}"""
    select = f""",
bounds AS (
  SELECT min(InvoiceDate) AS low, epoch_us(max(InvoiceDate)) - epoch_us(min(InvoiceDate)) AS r FROM {table}
),
binned AS (
  SELECT {category},
         CASE WHEN r = 0 THEN 1
              ELSE (58 * (epoch_us(InvoiceDate) - epoch_us(low)) + 3 * r - 1) // (2 * r) END AS bin,
         count(*) AS n
  FROM {table}, bounds GROUP BY 1, 2
),
filled AS ({rows})
SELECT bin, low + to_microseconds((2 * bin + 55) * r // 58 - r) AS bin_start,
       low + to_microseconds((2 * bin + 57) * r // 58 - r) AS bin_end, {category}, n
FROM filled, bounds"""
    return "WITH " + ",".join([RAW, _relations(order=order)]) + select


def _map(measure: str, columns: str) -> str:
    return _sql(
        f"""
SELECT b.*, {columns} FROM boundaries b JOIN {measure} m ON b.region = m.Country
WHERE b.region IN (SELECT Country FROM geo_sales)""",
        geography=True,
    )


def _coded_map(measure: str) -> str:
    return _sql(
        f"""
SELECT b.*, m.n, dense_rank() OVER (ORDER BY m.n) AS n_code
FROM boundaries b JOIN {measure} m ON b.region = m.Country""",
        geography=True,
    )


def _points(measure: str, column: str) -> str:
    return _sql(
        f"""
SELECT m.Country, lon, lat, CAST({column} AS DOUBLE) AS measure, 'gazetteer' AS source
FROM {measure} m LEFT JOIN gazetteer g ON m.Country = g.Country""",
        geography=True,
    )


# The number of a line in input that numbers its lines.
LINE_NO = f"""(l_orderkey * 8 + l_linenumber) * {LINE_STRIDE} + (l_partkey * 1000003 + l_suppkey * 7919
    + CAST(round(l_extendedprice * 100) AS BIGINT)) % {LINE_STRIDE}"""
WIDE = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country"
LINE = "StockCode, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, lines.InvoiceNo"
CLEAN = f"SELECT {LINE.replace('lines.', '')}, InvoiceDate, CustomerID, Country, Description FROM clean"
JOIN_INVOICES = f"""
SELECT {LINE}, InvoiceDate, CustomerID, Country
FROM lines LEFT JOIN invoices ON lines.InvoiceNo IS NOT DISTINCT FROM invoices.InvoiceNo"""
SKU_BY_COUNTRY = """
SELECT Country, count(*) AS n FROM (SELECT DISTINCT Country, StockCode FROM clean)
GROUP BY Country ORDER BY n DESC, Country NULLS LAST"""
PURCHASES = """
SELECT CustomerID, count(*) AS n FROM invoices WHERE CustomerID IS NOT NULL
GROUP BY CustomerID ORDER BY n DESC, CustomerID"""

ORACLE: dict[str, str] = {
    "purchases_per_customer": _sql(PURCHASES),
    "mean_purchases": _sql("""
SELECT CAST(sum(n) AS DOUBLE) / count(*) AS mean_n
FROM (SELECT CustomerID, count(*) AS n FROM invoices GROUP BY CustomerID)"""),
    "list_countries": _sql("SELECT DISTINCT Country FROM invoices ORDER BY Country NULLS LAST"),
    "hist_invoices_country": _histogram("invoices", "Country"),
    "hist_lines_region": _histogram("clean", "Region"),
    "hist_lines_region_dense": _histogram("clean", "Region", dense=True),
    "sales_by_region": _sales("Region"),
    "sales_by_country": _sales("Country"),
    "price_by_region_sku": _sql(f"""
SELECT Region, StockCode, CAST(sum(UnitPrice) AS DOUBLE) / count(*) AS precio_promedio,
       count(*) AS unidades
FROM clean GROUP BY Region, StockCode HAVING StockCode IN {_list(SKUS)}
ORDER BY unidades DESC, Region NULLS LAST, StockCode"""),
    "sku_by_region": _sql("""
SELECT Region, count(*) AS n FROM (SELECT DISTINCT Region, StockCode FROM clean)
GROUP BY Region ORDER BY n DESC, Region NULLS LAST"""),
    "sku_by_country": _sql(SKU_BY_COUNTRY),
    "geo_sales": _sql("SELECT * FROM geo_sales ORDER BY total_invoice DESC, Country", geography=True),
    "avg_ticket_by_country": _sql(
        "SELECT * FROM geo_ticket ORDER BY venta_promedio DESC, Country", geography=True
    ),
    "customers_by_country": _sql("SELECT * FROM geo_customers ORDER BY n DESC, Country", geography=True),
    "products_by_country": _sql("SELECT * FROM geo_products ORDER BY n DESC, Country", geography=True),
    "map_total_sales": _map("geo_sales", "m.total_invoice"),
    "map_avg_ticket": _map("geo_ticket", "m.venta_promedio"),
    "map_customers": _coded_map("geo_customers"),
    "map_products": _coded_map("geo_products"),
    "geo_point_series": _points("geo_products", "n"),
    "geo_point_series_avg_ticket": _points("geo_ticket", "venta_promedio"),
    "geo_point_series_customers": _points("geo_customers", "n"),
    "geo_point_series_total_sales": _points("geo_sales", "total_invoice"),
    "customer_scatter_series": _sql(PURCHASES),
    "scan_retail": _sql(f"SELECT {WIDE} FROM raw", raw_only=True),
    "scan_boundaries": _sql("SELECT * FROM boundaries", geography=True),
    "geocode_join": _sql(
        """
SELECT s.Country, total_invoice, lon, lat, 'gazetteer' AS source
FROM geo_sales s LEFT JOIN gazetteer g ON s.Country = g.Country""",
        geography=True,
    ),
    "limit_print": _sql("SELECT * FROM geo_products ORDER BY n DESC, Country LIMIT 22", geography=True),
    "export_country_sales": _sql(
        """
SELECT Country, total_invoice AS "Ventas Totales" FROM geo_sales
ORDER BY "Ventas Totales" DESC, Country""",
        geography=True,
    ),
    "project_upper": _sql("SELECT InvoiceNo, upper(StockCode) AS StockCode FROM raw", raw_only=True),
    "project_lines": _sql(f"SELECT {LINE} FROM lines"),
    "project_total": _sql(
        "SELECT InvoiceNo, StockCode, CAST(UnitPrice * Quantity AS DOUBLE) AS Total FROM valid"
    ),
    "classify_region": _sql(f"SELECT InvoiceNo, Country, {REGION_OF} AS Region FROM raw", raw_only=True),
    "filter_in_list": _sql(f"SELECT {LINE} FROM lines WHERE StockCode IN {_list(SKUS)}"),
    "normalize_country": _sql(f"SELECT InvoiceNo, {_renamed('Country')} AS Country FROM raw", raw_only=True),
    "share_of_total": _sql("""
SELECT StockCode, CAST(total AS DOUBLE) AS total,
       CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS porcentage
FROM (SELECT StockCode, sum(UnitPrice * Quantity) AS total FROM valid GROUP BY StockCode)"""),
    "factor_code": _sql("""
SELECT CustomerID, n, dense_rank() OVER (ORDER BY n) AS n_code
FROM (SELECT CustomerID, count(*) AS n FROM invoices GROUP BY CustomerID)"""),
    "filter_not_null": _sql(
        "SELECT InvoiceNo, CustomerID FROM raw WHERE CustomerID IS NOT NULL", raw_only=True
    ),
    "round_half_even": _sql(
        "SELECT Country, round_even(venta_promedio, 0) AS venta_promedio FROM geo_ticket", geography=True
    ),
    "filter_valid_lines": _sql(f"SELECT {WIDE} FROM valid"),
    "join_invoices": _sql(JOIN_INVOICES),
    "join_products": _sql(f"""
SELECT {LINE.replace("StockCode", "lines.StockCode")}, Description
FROM lines LEFT JOIN products ON lines.StockCode IS NOT DISTINCT FROM products.StockCode"""),
    "join_null_safe": "WITH " + ",".join([RAW, RAW_LOST, _relations("raw_lost")]) + JOIN_INVOICES,
    "join_natural": _sql(f"""
SELECT StockCode, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice, InvoiceNo, InvoiceDate, CustomerID, Country
FROM lines NATURAL LEFT JOIN invoices"""),
    "join_boundaries": _sql(
        "SELECT b.*, total_invoice FROM boundaries b LEFT JOIN geo_sales s ON b.region = s.Country",
        geography=True,
    ),
    "semi_join_boundaries": _sql(
        "SELECT * FROM boundaries WHERE region IN (SELECT Country FROM geo_sales)", geography=True
    ),
    "distinct_multi": _sql("SELECT DISTINCT InvoiceNo, InvoiceDate, CustomerID, Country FROM valid"),
    "normalize_invoices": _sql("SELECT * FROM invoices"),
    "normalize_products": _sql("SELECT * FROM products"),
    "clean_retail": _sql(CLEAN),
    "top_n_sku_region": _sql("""
SELECT Region, StockCode, count(*) AS unidades FROM clean GROUP BY Region, StockCode
ORDER BY unidades DESC, Region NULLS LAST, StockCode LIMIT 22"""),
}

# The readers, and the model written by store, give what the other way gives.
ORACLE |= {
    "scan_retail_csv": ORACLE["scan_retail"],
    "scan_retail_converted": ORACLE["scan_retail"],
    "export_country_sales_csv": ORACLE["export_country_sales"],
    "clean_retail_numbered": _sql(CLEAN, order=LINE_NO),
    "invoices_csv": _sql("SELECT * FROM invoices", order=LINE_NO),
    "stored_clean": _sql(CLEAN, order=LINE_NO),
    "stored_sales_by_country": _sales("Country", LINE_NO),
    "stored_sku_by_country": _sql(SKU_BY_COUNTRY, order=LINE_NO),
}

CUSTOMERS = "SELECT * FROM geo_customers ORDER BY n DESC, Country"
SKU_BY_REGION = """
SELECT Region, count(*) AS n FROM (SELECT DISTINCT Region, StockCode FROM clean)
GROUP BY Region"""


def _close(counts: str, order: str = ORDER) -> str:
    return _sql(f"SELECT *, true AS close FROM ({counts.split('ORDER BY')[0]})", order=order)


# All lines of the first load come before those of the second.
LOADS = f"CAST({SECOND_LOAD} AS INTEGER), {LINE_NO}"
ORACLE |= {
    "stored_sku_by_region": _sql(SKU_BY_REGION, order=LINE_NO),
    "stored_customers_by_country": _sql(CUSTOMERS, geography=True, order=LINE_NO),
    "stored_hist_lines_region": _histogram("clean", "Region", order=LINE_NO),
    "stored_sku_by_country_approx": _close(SKU_BY_COUNTRY, LINE_NO),
    "sku_by_region_approx": _close(SKU_BY_REGION),
    "merged_clean": _sql(CLEAN, order=LOADS),
    "merged_invoices": _sql("SELECT * FROM invoices", order=LOADS),
    "merged_products": _sql("SELECT * FROM products", order=LOADS),
    "merged_sales_by_country": _sales("Country", LOADS),
    "merged_sku_by_country": _sql(SKU_BY_COUNTRY, order=LOADS),
    "merged_customers_by_country": _sql(CUSTOMERS, geography=True, order=LOADS),
    "merged_hist_invoices_country": _histogram("invoices", "Country", order=LOADS),
    "merged_sku_by_country_approx": _close(SKU_BY_COUNTRY, LOADS),
    "classify_region_table": ORACLE["classify_region"],
    "classify_customer_table": _sql(
        """
SELECT InvoiceNo, CustomerID, coalesce(label, 'unknown') AS Segment FROM raw LEFT JOIN (
  SELECT value, label FROM (
    SELECT *, row_number() OVER (PARTITION BY value ORDER BY branch, label) AS rn FROM (
      SELECT c_nationkey AS branch, CAST(c_custkey AS VARCHAR) AS value, c_mktsegment AS label FROM customer
      UNION ALL SELECT 12, CAST(c_custkey AS VARCHAR), 'LATE' FROM customer))
  WHERE rn = 1) ON CustomerID = value""",
        raw_only=True,
    ),
    "scan_retail_dense": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS different FROM lineitem",
    "scan_retail_good": _sql(
        f"""
SELECT {WIDE}, line_no AS row_order FROM (SELECT *, {LINE_NO} AS line_no FROM raw)
WHERE line_no % {BAD_QUANTITY} <> 0 AND line_no % {BAD_PRICE} <> 0 AND line_no % {BAD_DATE} <> 0""",
        raw_only=True,
    ),
    "scan_retail_rejects": _sql(
        f"""
SELECT line_no, CASE WHEN line_no % {BAD_QUANTITY} = 0 THEN 'Quantity: not int: many'
                     WHEN line_no % {BAD_DATE} = 0 THEN 'InvoiceDate: not timestamp_ntz: yesterday'
                     ELSE 'UnitPrice: not decimal(12,3): 1.2345' END AS reason,
       CASE WHEN line_no % {BAD_QUANTITY} = 0 THEN 'many' ELSE CAST(Quantity AS VARCHAR) END AS quantity
FROM (SELECT *, {LINE_NO} AS line_no FROM raw)
WHERE line_no % {BAD_QUANTITY} = 0 OR line_no % {BAD_PRICE} = 0 OR line_no % {BAD_DATE} = 0""",
        raw_only=True,
    ),
    # Every name against every place.
    "geocode_forgiving": r"""
WITH lines AS (
  SELECT p_name, l_orderkey % 4 AS k, CAST(l_orderkey % length(p_name) AS INTEGER) AS cut
  FROM lineitem JOIN part ON l_partkey = p_partkey
), names AS (
  SELECT Country, count(*) AS n FROM (
    SELECT CASE k WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
                  WHEN 2 THEN substr(p_name, 1, cut) || substr(p_name, cut + 2)
                  ELSE substr(p_name, 1, cut) || 'q' || substr(p_name, cut + 1) END AS Country FROM lines)
  GROUP BY Country
), places AS (
  SELECT p_name AS place, CAST(min(p_partkey) % 360 - 180 AS DOUBLE) AS lon,
    CAST(min(p_partkey) % 180 - 90 AS DOUBLE) AS lat
  FROM part GROUP BY p_name
), pairs AS (
  SELECT Country, place, levenshtein(lower(trim(regexp_replace(Country, '\s+', ' ', 'g'))), place) AS d,
    greatest(length(trim(regexp_replace(Country, '\s+', ' ', 'g'))), length(place)) AS l
  FROM names, places
), ranked AS (
  SELECT Country, place, rank() OVER (PARTITION BY Country ORDER BY CASE WHEN Country = place THEN 0 ELSE d + 1 END) AS r
  FROM pairs WHERE d <= CASE WHEN l < 3 THEN 0 WHEN l < 6 THEN 1 ELSE 2 END
), best AS (
  SELECT Country, min(place) AS place FROM ranked WHERE r = 1 GROUP BY Country HAVING count(*) = 1
)
SELECT names.Country, n, lon, lat, 'gazetteer' AS source
FROM names LEFT JOIN best USING (Country) LEFT JOIN places USING (place)""",
}
