"""Small invoice-line tables and their brute-force analysis in plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import types as T

from tillroll.schema import MAP_NAMES, REGIONS, RETAIL_SCHEMA, ROW_ORDER

SCHEMA = T.StructType([*RETAIL_SCHEMA, T.StructField(ROW_ORDER, T.LongType(), False)])
NAMES = SCHEMA.names

D1 = datetime(2011, 1, 4, 10, 0)
D2 = datetime(2011, 3, 1, 9, 30)
D3 = datetime(2011, 12, 9, 12, 50)


def line(inv, sku, desc, qty, date, price, cust, country):
    price = None if price is None else Decimal(price)
    return (inv, sku, desc, qty, date, price, cust, country)


# In input order; the row order is attached below.
TINY = [
    # one product in two spellings, its first description missing
    line("1", "85123a", None, 6, D1, "2.550", "c1", "United Kingdom"),
    # one invoice with two dates, customers and countries
    line("1", "85123A", "HOLDER", 2, D2, "3.000", "c2", "France"),
    # exact duplicates
    line("2", "22423", "CAKESTAND", 1, D2, "12.750", None, "EIRE"),
    line("2", "22423", "CAKESTAND", 1, D2, "12.750", None, "EIRE"),
    # invalid lines, also as the first line of an invoice
    line("3", "22423", "RETURN", -1, D1, "12.750", "c9", "Spain"),
    line("3", "85099B", "BAG", 10, D2, "1.950", "c3", "Hong Kong"),
    line("4", "85099B", "BAG", 0, D1, "1.950", "c3", "RSA"),
    line("4", "85099B", "BAG", None, D1, "1.950", "c3", "RSA"),
    line("4", "85099B", "BAG", 5, D1, "0.000", "c3", "RSA"),
    line("4", "85099B", "BAG", 5, D1, None, "c3", "RSA"),
    line("5", "POST", "POSTAGE", 1, D3, "18.000", None, "RSA"),
    line("6", "post", "Postage", 1, D3, "18.000", "c1", "Channel Islands"),
    # no region; tie in value with invoices 5 and 6
    line("7", "POST", "POSTAGE", 1, D3, "18.000", "c4", "Atlantis"),
    line("8", "NEW", "NEW ITEM", 3, D1, "0.001", "c4", "United Kingdom"),
    # lost keys
    line(None, "22423", "CAKESTAND", 2, D2, "10.000", "c5", "Germany"),
    line(None, None, "UNKNOWN", 2, D3, "1.000", "c6", "Japan"),
    line("9", None, None, 4, D3, "2.000", "c6", None),
]


def with_order(rows):
    return [(*row, i) for i, row in enumerate(rows)]


def random_rows(seed: int, n: int = 400):
    """Lines with every kind of dirt; a third belong to one invoice and a third to one product."""
    rng = random.Random(seed)
    countries = [c for cs in REGIONS.values() for c in cs] + ["Atlantis", None]
    rows = []
    for _ in range(n):
        inv = "hot" if rng.random() < 0.33 else rng.choice([None, *map(str, range(60))])
        sku = "hot" if rng.random() < 0.33 else rng.choice([None, "85123a", "85123A", "22423", "a", "A", "b1", "B1", "z"])
        rows.append(
            line(
                inv,
                sku,
                rng.choice([None, "d1", "d2", "d3"]),
                rng.choice([None, -3, 0, 1, 1, 2, 7, 40]),
                rng.choice([None, *[D1 + timedelta(minutes=rng.randrange(400000)) for _ in range(9)]]),
                rng.choice([None, "0.000", "-1.000", "0.850", "1.250", "99.999", "1.250"]),
                rng.choice([None, "c1", "c2", "c3", "c4", "c5"]),
                rng.choice(countries),
            )
        )
    return rows


def frame(spark, rows, partitions: int | None = None):
    df = spark.createDataFrame(with_order(rows), SCHEMA)
    return df.repartition(partitions, "Description") if partitions else df


class Brute:
    """The definitions of the analyses, one line after another."""

    def __init__(self, rows):
        self.valid = []
        for r in rows:
            r = dict(zip(NAMES, r))
            r["StockCode"] = r["StockCode"] and r["StockCode"].upper()
            if r["Quantity"] and r["Quantity"] > 0 and r["UnitPrice"] and r["UnitPrice"] > 0:
                self.valid.append(r)
        self.invoices, self.products = {}, {}
        for r in self.valid:
            self.invoices.setdefault(r["InvoiceNo"], r)
            self.products.setdefault(r["StockCode"], r["Description"])
        self.clean = []
        for r in self.valid:
            i = self.invoices[r["InvoiceNo"]]
            self.clean.append(
                {
                    **r,
                    "InvoiceDate": i["InvoiceDate"],
                    "CustomerID": i["CustomerID"],
                    "Country": i["Country"],
                    "Description": self.products[r["StockCode"]],
                    "Total": r["UnitPrice"] * r["Quantity"],
                    "Region": next((k for k, v in REGIONS.items() if i["Country"] in v), None),
                    "Geo": MAP_NAMES.get(i["Country"], i["Country"]),
                }
            )

    @staticmethod
    def report(pairs):
        """Highest measure first, then by key, NULL last."""
        return sorted(pairs, key=lambda p: (-p[1], *[(k is None, k or "") for k in p[:1]]))

    def sums(self, key):
        out = defaultdict(Decimal)
        for r in self.clean:
            out[r[key]] += r["Total"]
        return out

    def sales(self, key):
        sums = self.sums(key)
        total = float(sum(sums.values()))
        return self.report([(k, float(v), float(v) / total) for k, v in sums.items()])

    def geo_sales(self):
        return self.report([(k, float(v)) for k, v in self.sums("Geo").items()])

    def tickets(self):
        invoices = defaultdict(Decimal)
        for r in self.clean:
            invoices[r["InvoiceNo"], r["Geo"]] += r["Total"]
        per = defaultdict(list)
        for (_, c), v in invoices.items():
            per[c].append(v)
        return self.report([(c, float(sum(v)) / len(v)) for c, v in per.items()])

    def variety(self, group, value):
        pairs = {(r[group], r[value]) for r in self.clean}
        return self.report(Counter(g for g, _ in pairs).items())

    def purchases(self):
        return Counter(i["CustomerID"] for i in self.invoices.values())

    def prices(self, skus):
        per = defaultdict(list)
        for r in self.clean:
            if r["StockCode"] in skus:
                per[r["Region"], r["StockCode"]].append(r["UnitPrice"])
        rows = [(*k, float(sum(v)) / len(v), len(v)) for k, v in per.items()]
        return sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or "", r[1]))

    def histogram(self, rows, category, bins=30):
        """Bins from exact fractions of the range."""
        from fractions import Fraction
        from math import ceil

        micros = lambda t: (t - D1) // timedelta(microseconds=1)
        rows = [r for r in rows if r["InvoiceDate"] is not None]
        times = [micros(r["InvoiceDate"]) for r in rows]
        low, width = min(times), Fraction(max(times) - min(times), bins - 1)
        count = Counter()
        for t, r in zip(times, rows):
            k = 1 if width == 0 else max(1, ceil((t - low) / width + Fraction(1, 2)))
            count[k, r[category]] += 1
        return count
