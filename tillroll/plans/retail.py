"""The cleaned retail model.

Raw lines are validated, split into invoices, invoice lines and products, and
joined back, so that every invoice has one date, customer and country and every
product one description. All lines stay, exact duplicates included.

Most analyses need only what the invoice of a line says, and sums over its lines.
Those read ``facts``: one aggregation over the lines, one shuffle with partial
aggregation in front, and no join. Only product questions read ``sku_lines``,
where lines are joined to the country of their invoice.

``Retail`` computes everything from the raw lines, each time. ``Retail.store``
writes the cleaned table and the facts once, for the many analyses that follow, and
``StoredRetail.add`` puts a new load behind them: only what the load touches is repaired.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.expressions import line_total
from tillroll.operators.aggregates import count_distinct_by
from tillroll.operators.joins import drop_matching, inner_lookup, left_lookup
from tillroll.operators.keyed import distinct_with_first, first_by_key
from tillroll.operators.numbering import value_codes
from tillroll.operators.variety import (
    bitmaps,
    count_bitmaps,
    estimate_sketches,
    merge_bitmaps,
    merge_sketches,
    sketches,
)
from tillroll.schema import INVOICE_COLUMNS, ROW_ORDER, in_file_order
from tillroll.session import at_once, hadoop_path, require_reachable, shared_folder


def upper_codes(raw: DataFrame) -> DataFrame:
    """``raw`` with product codes in capitals; lines read without them stay as they are."""
    return raw.withColumn("StockCode", F.upper("StockCode")) if "StockCode" in raw.columns else raw


def valid_lines(raw: DataFrame) -> DataFrame:
    """Upper-case product codes; drop returns, free items and lines without quantity or price."""
    return upper_codes(raw).where((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def normalize_invoices(lines: DataFrame, columns=INVOICE_COLUMNS) -> DataFrame:
    """One row per invoice, with the date, customer and country of its first line."""
    return first_by_key(lines, "InvoiceNo", columns, ROW_ORDER)


def invoice_lines(lines: DataFrame) -> DataFrame:
    return lines.select("StockCode", "Quantity", "UnitPrice", "InvoiceNo")


def normalize_products(lines: DataFrame, *more: Column) -> DataFrame:
    """One row per product code, with the description of its first line."""
    if in_file_order(lines):
        # A task reads few products from few files.
        lines = distinct_with_first(lines, "StockCode", "Description", order=ROW_ORDER)
    return first_by_key(lines, "StockCode", ["Description"], ROW_ORDER, more)


def join_relations(
    lines: DataFrame, invoices: DataFrame, products: DataFrame, null_safe: bool = True
) -> DataFrame:
    """Lines with the columns of their invoice and product."""
    with_invoice = left_lookup(lines, invoices, "InvoiceNo", null_safe)
    return left_lookup(with_invoice, products, "StockCode", null_safe)


def invoice_sums() -> list[Column]:
    return [F.sum(line_total()).alias("total"), F.count(F.lit(1)).alias("n_lines")]


def repair_lines(lines: DataFrame, repairs: DataFrame) -> DataFrame:
    """Lines whose invoice is among ``repairs`` take its attributes, the others keep their own."""
    names = {c: f"_{c}" for c in INVOICE_COLUMNS}
    found = repairs.withColumnsRenamed(names).withColumn("_mixed", F.lit(True))
    return left_lookup(lines, found, "InvoiceNo").select(
        *[c for c in lines.columns if c not in names],
        *[F.when(F.col("_mixed"), F.col(r)).otherwise(F.col(c)).alias(c) for c, r in names.items()],
    )


def repaired_table(lines: DataFrame, repairs: DataFrame, products: DataFrame) -> DataFrame:
    """The wide table from valid lines, the invoices to repair, and the products.

    Holds the same rows as ``join_relations``. Read the two small sides from
    written tables: Spark then knows their true size, broadcasts them if it is
    under the threshold, so that the lines are not shuffled at all, and
    sort-merges otherwise.
    """
    lines = lines.select("StockCode", "Quantity", "UnitPrice", "InvoiceNo", *INVOICE_COLUMNS)
    return left_lookup(repair_lines(lines, repairs), products, "StockCode")


class Retail:
    """Analysis model over raw lines that carry a ``row_order`` column."""

    def __init__(self, raw: DataFrame):
        self.lines = valid_lines(raw)

    def invoices(self, *columns: str) -> DataFrame:
        return normalize_invoices(self.lines, columns or INVOICE_COLUMNS)

    def invoice_lines(self) -> DataFrame:
        return invoice_lines(self.lines)

    def products(self) -> DataFrame:
        return normalize_products(self.lines)

    def clean(self, null_safe: bool = True) -> DataFrame:
        """The wide table: one row per valid line.

        With ``null_safe=False`` a line without invoice number or product code
        finds no invoice or product.
        """
        return join_relations(self.invoice_lines(), self.invoices(), self.products(), null_safe)

    def facts(self, *columns: str) -> DataFrame:
        """Invoices with the chosen attributes, their ``total`` and their ``n_lines``."""
        return first_by_key(
            self.lines, "InvoiceNo", columns or INVOICE_COLUMNS, ROW_ORDER, invoice_sums()
        )

    def sku_lines(self) -> DataFrame:
        """Product code, price and repaired country of every valid line."""
        # Each line has its invoice, so an inner join keeps them all, and lets
        # Spark broadcast the lines where a filter on products leaves few.
        lines = self.lines.select("InvoiceNo", "StockCode", "UnitPrice")
        return inner_lookup(lines, self.invoices("Country"), "InvoiceNo").drop("InvoiceNo")

    def times(self) -> tuple[DataFrame, DataFrame | None]:
        """InvoiceDate, Country, n_invoices and n_lines, and the range of the dates if it is known."""
        return self.facts("InvoiceDate", "Country").withColumn("n_invoices", F.lit(1)), None

    def _valued(self, value: str) -> DataFrame:
        return self.sku_lines() if value == "StockCode" else self.facts(value, "Country")

    def variety(
        self, value: str, grouped: Grouping | None = None, group: str = "Country", include_null: bool = True
    ) -> DataFrame:
        """Different values of StockCode or CustomerID, as ``n``, per country, or per ``group`` as
        ``grouped`` finds it from a Country column."""
        rows = self._valued(value)
        return count_distinct_by(grouped(rows) if grouped else rows, group, value, include_null)

    def variety_approx(
        self, value: str, grouped: Grouping | None = None, group: str = "Country", include_null: bool = True
    ) -> DataFrame:
        """``variety`` by sketches: estimates, and only sketches are shuffled."""
        rows = self._valued(value)
        return estimate_sketches(sketches(grouped(rows) if grouped else rows, group, value), group, include_null)

    def store(self, folder: str | None = None) -> StoredRetail:
        """Write the cleaned table and the invoice facts; return a model that reads them.

        Without ``folder`` they go below the session's ``spark.checkpoint.dir``. On a cluster a
        folder on a local disk is refused. ``StoredRetail.remove`` deletes the tables.

        Only invoices whose lines disagree need repair, in most tables a small part.
        """
        spark = self.lines.sparkSession
        folder = require_reachable(spark, folder or f"{shared_folder(spark)}/retail-{uuid.uuid4().hex}")
        write = _Writer(spark, folder, 0)
        found = normalize_products(self.lines, F.min(ROW_ORDER).alias(ROW_ORDER))
        facts, new = write.all(facts=_first_facts(self.lines), new_products=found)
        repairs, known, _, _ = write.all(
            repairs=facts.where("mixed").select("InvoiceNo", *INVOICE_COLUMNS),
            new_customers=facts.select("CustomerID").distinct(),
            times=_times(facts),
            meta=_meta(self.lines, facts),
        )
        products, customers = write.all(products=_coded(new), customers=value_codes(known, "CustomerID", "code"))
        clean = write(repaired_table(self.lines, repairs, products.select("StockCode", "Description")), "clean")
        sold = write(_sold(clean), "sold")
        write.all(bitmaps=_country_bitmaps(sold, products, facts, customers), sketches=_country_sketches(sold, facts))
        return write.done()


Grouping = Callable[[DataFrame], DataFrame]

# What the two distinct counts by country are of.
VALUES = ("StockCode", "CustomerID")


class _Writer:
    """Writes the tables of one version of a stored model and reads them back."""

    def __init__(self, spark: SparkSession, folder: str, version: int):
        self.spark, self.folder, self.version = spark, folder, version

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{self.version}/{name}"
        # A version that was not finished may have left a table.
        df.write.mode("errorifexists" if self.version == 0 else "overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, **tables: DataFrame) -> list[DataFrame]:
        """Write tables that don't read one another, at once."""
        return at_once(self.spark, *[partial(self, df, name) for name, df in tables.items()])

    def done(self) -> StoredRetail:
        """Readers see the version from now on."""
        files, path = hadoop_path(self.spark, f"{self.folder}/{self.version}/{_DONE}")
        files.create(path, True).close()
        return StoredRetail(self.spark, self.folder, self.version)


_DONE = "_DONE"


def _first_facts(lines: DataFrame) -> DataFrame:
    firsts = [F.min(ROW_ORDER).alias(ROW_ORDER)]
    return first_by_key(lines, "InvoiceNo", INVOICE_COLUMNS, ROW_ORDER, [*invoice_sums(), *firsts], mixed="mixed")


def _coded(products: DataFrame, after: int = 0) -> DataFrame:
    """Products with a code. Pass a written table: it is read several times."""
    return left_lookup(products, value_codes(products, "StockCode", "code", after), "StockCode")


def _sold(clean: DataFrame) -> DataFrame:
    """Which products each country has. Pairs are few beside lines, and hashing them
    spares the bitmaps, which Spark aggregates by sorting, all the lines."""
    return clean.select("Country", "StockCode").distinct()


def _both(products: DataFrame, customers: DataFrame) -> DataFrame:
    named = lambda df, value: df.select(F.lit(value).alias("value"), *df.columns)
    return named(products, VALUES[0]).unionByName(named(customers, VALUES[1]))


def _country_bitmaps(sold: DataFrame, products: DataFrame, facts: DataFrame, customers: DataFrame) -> DataFrame:
    """Which codes of products and customers each country has."""
    sold = left_lookup(sold, products.select("StockCode", "code"), "StockCode")
    known = left_lookup(facts.select("CustomerID", "Country"), customers, "CustomerID")
    return _both(bitmaps(sold, "Country", "code"), bitmaps(known, "Country", "code"))


def _country_sketches(sold: DataFrame, facts: DataFrame) -> DataFrame:
    return _both(sketches(sold, "Country", "StockCode"), sketches(facts, "Country", "CustomerID"))


def _times(facts: DataFrame) -> DataFrame:
    """The histograms' finest bins: invoices and lines for each date and country."""
    one = F.sum(F.lit(1).cast("bigint")).alias("n_invoices")
    return facts.groupBy("InvoiceDate", "Country").agg(one, F.sum("n_lines").alias("n_lines"))


def _merged_facts(old: DataFrame, load: DataFrame) -> DataFrame:
    """Facts of both, and whether the load ``touched`` the invoice; one join, from which the
    touched ones are picked out."""
    names = {c: f"_{c}" for c in old.columns}
    marked = load.withColumn("_new", F.lit(True))
    earlier = old.withColumnsRenamed(names).withColumn("_old", F.lit(True))
    both = marked.join(earlier, F.col("InvoiceNo").eqNullSafe(F.col("_InvoiceNo")), "full")
    known, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    same = F.lit(True)
    for c in INVOICE_COLUMNS:
        same = same & F.col(c).eqNullSafe(F.col(names[c]))
    kept = lambda c: F.when(known, F.col(names[c])).otherwise(F.col(c)).alias(c)
    renewed = lambda c, value: F.when(new, value).otherwise(F.col(names[c])).cast(load.schema[c].dataType).alias(c)
    summed = lambda c: renewed(c, F.col(c) + F.coalesce(F.col(names[c]), F.lit(0)))
    return both.select(
        *[kept(c) for c in ("InvoiceNo", *INVOICE_COLUMNS)],
        summed("total"),
        summed("n_lines"),
        kept(ROW_ORDER),
        renewed("mixed", F.col("mixed") | F.coalesce(names["mixed"], F.lit(False)) | (known & ~same)),
        new.alias("touched"),
    )


def _numbered(lines: DataFrame) -> bool:
    return isinstance(lines.schema[ROW_ORDER].dataType, T.NumericType)


def _meta(lines: DataFrame, facts: DataFrame, start: int = 0) -> DataFrame:
    """One row: the range of the dates, and the number after that of the last line, if lines have numbers."""
    last = F.max(ROW_ORDER) if _numbered(lines) else F.lit(None)
    after = lines.agg(F.coalesce(last.cast("bigint") + 1, F.lit(start)).alias("next"))
    dates = facts.agg(F.min("InvoiceDate").alias("low"), F.max("InvoiceDate").alias("high"))
    return after.select("next", *[dates.select(c).scalar().alias(c) for c in ("low", "high")])


class StoredRetail:
    """The model read back from tables written by ``Retail.store`` and ``add``.

    A folder has a subfolder for each version, 0 and up. Facts, products and the small tables
    are whole in each version; the cleaned table is the sum of all versions' lines.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark = spark
        self.folder = folder
        self.version = max(self._versions(finished=True)) if version is None else version

    def _versions(self, finished: bool = False) -> list[int]:
        files, path = hadoop_path(self.spark, self.folder)
        found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().isdigit()] if files.exists(path) else []
        names = [p.getName() for p in found]
        if finished:
            names = [n for n in names if files.exists(hadoop_path(self.spark, f"{self.folder}/{n}/{_DONE}")[1])]
        return [int(n) for n in names]

    def _path(self, name: str, version: int | None = None) -> str:
        return f"{self.folder}/{self.version if version is None else version}/{name}"

    def table(self, name: str) -> DataFrame:
        """facts, repairs, products, customers, bitmaps, sketches, times or meta."""
        return self.spark.read.parquet(self._path(name))

    def clean(self) -> DataFrame:
        return self.spark.read.parquet(*[self._path("clean", v) for v in range(self.version + 1)])

    def products(self) -> DataFrame:
        return self.table("products").select("StockCode", "Description")

    def invoice_lines(self) -> DataFrame:
        return invoice_lines(self.clean())

    def facts(self, *columns: str) -> DataFrame:
        columns = columns or INVOICE_COLUMNS
        return self.table("facts").select("InvoiceNo", *columns, "total", "n_lines")

    def invoices(self, *columns: str) -> DataFrame:
        return self.facts(*columns).drop("total", "n_lines")

    def sku_lines(self) -> DataFrame:
        return self.clean().select("StockCode", "UnitPrice", "Country")

    def times(self) -> tuple[DataFrame, DataFrame]:
        return self.table("times"), self.table("meta").select("low", "high")

    def _merged(self, name: str, value: str, grouped: Grouping | None) -> DataFrame:
        rows = self.table(name).where(F.col("value") == value).drop("value")
        return grouped(rows) if grouped else rows

    def variety(
        self, value: str, grouped: Grouping | None = None, group: str = "Country", include_null: bool = True
    ) -> DataFrame:
        """As ``Retail.variety``, from the bitmaps; the lines are not read."""
        return count_bitmaps(self._merged("bitmaps", value, grouped), group, include_null)

    def variety_approx(
        self, value: str, grouped: Grouping | None = None, group: str = "Country", include_null: bool = True
    ) -> DataFrame:
        return estimate_sketches(self._merged("sketches", value, grouped), group, include_null)

    def add(self, raw: DataFrame) -> StoredRetail:
        """Put the lines of ``raw`` behind those of the model; return the new version.

        The result is that of storing both loads at once, the old lines first, but the numbers of lines
        and the codes of values. The new lines' numbers may start anew or go on. An invoice keeps the attributes of its first
        line, so no old line changes: new lines are repaired where their invoice, old or new, says
        otherwise, and of the facts only the rows of the load's invoices are made anew. An
        addition that fails leaves the model as it was.
        """
        meta = self.table("meta").first()
        if not (_numbered(raw) and _numbered(self.table("facts"))):
            raise ValueError("loads are merged by number of line: read them with a sequence, or with dense=True")
        start = meta["next"]
        lines = valid_lines(raw).withColumn(ROW_ORDER, (F.col(ROW_ORDER) + start).cast("bigint"))
        write = _Writer(self.spark, self.folder, self.version + 1)

        old = {name: self.table(name) for name in ("facts", "products", "customers", "bitmaps", "sketches", "times")}
        found = normalize_products(lines, F.min(ROW_ORDER).alias(ROW_ORDER))
        new = drop_matching(found, old["products"].select("StockCode"), "StockCode")
        load, new = write.all(load=_first_facts(lines), new_products=new)
        facts = write(_merged_facts(old["facts"].select(*load.columns), load), "facts")
        touched = facts.where("touched").drop("touched")
        facts = facts.drop("touched")
        strangers = drop_matching(touched.select("CustomerID"), old["customers"].select("CustomerID"), "CustomerID")
        touched, repairs, strangers, _, _ = write.all(
            touched=touched,
            repairs=touched.where("mixed").select("InvoiceNo", *INVOICE_COLUMNS),
            new_customers=strangers.distinct(),
            times=_times(facts),
            meta=_meta(lines, facts, start),
        )

        after = lambda name: old[name].agg(F.max("code")).first()[0] or 0
        products, customers = write.all(
            products=old["products"].unionByName(_coded(new, after("products"))),
            customers=old["customers"].unionByName(value_codes(strangers, "CustomerID", "code", after("customers"))),
        )

        clean = write(repaired_table(lines, repairs, products.select("StockCode", "Description")), "clean")
        sold = write(_sold(clean), "sold")
        more = [_country_bitmaps(sold, products, touched, customers), _country_sketches(sold, touched)]
        write.all(
            bitmaps=_by_value(more[0].unionByName(old["bitmaps"]), merge_bitmaps),
            sketches=_by_value(more[1].unionByName(old["sketches"]), merge_sketches),
        )
        return write.done()

    def remove(self) -> None:
        """Delete the model's tables, and their folder if nothing else is in it."""
        for version in self._versions():
            files, path = hadoop_path(self.spark, f"{self.folder}/{version}")
            files.delete(path, True)
        files, path = hadoop_path(self.spark, self.folder)
        if files.exists(path) and not files.listStatus(path):
            files.delete(path, False)


def _by_value(df: DataFrame, merge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Merge a table of both values by value and country."""
    keyed = df.withColumn("_key", F.struct("value", "Country")).drop("value", "Country")
    return merge(keyed, "_key").select("_key.*", *[c for c in keyed.columns if c != "_key"])


Model = Retail | StoredRetail
