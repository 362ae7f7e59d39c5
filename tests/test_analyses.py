"""Every analysis against brute force, on dirty tables and under different partitionings."""

import pytest
from data import TINY, Brute, frame, random_rows

from tillroll.operators.aggregates import mean_count, count_by
from tillroll.plans import analyses as a
from tillroll.plans.retail import Retail

TABLES = {"tiny": TINY, "random1": random_rows(1), "random2": random_rows(2, 900)}
CASES = [("tiny", 1), ("tiny", 7), ("random1", None), ("random2", 5)]


@pytest.fixture(scope="module", params=CASES, ids=lambda c: f"{c[0]}-{c[1]}")
def case(request, spark):
    name, partitions = request.param
    rows = TABLES[name]
    return Retail(frame(spark, rows, partitions)), Brute(rows)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_relations(case):
    model, brute = case
    assert dict((r[0], r[1:]) for r in rows(model.invoices())) == {
        k: (i["InvoiceDate"], i["CustomerID"], i["Country"]) for k, i in brute.invoices.items()
    }
    assert dict(rows(model.products())) == brute.products
    assert model.products().count() == len(brute.products)


def test_clean_keeps_every_line(case):
    model, brute = case
    clean = model.clean()
    expected = [tuple(r[c] for c in clean.columns) for r in brute.clean]
    assert sorted(rows(clean), key=repr) == sorted(expected, key=repr)
    assert clean.columns == [
        "StockCode", "Quantity", "UnitPrice", "InvoiceNo",
        "InvoiceDate", "CustomerID", "Country", "Description",
    ]


def test_clean_with_plain_equality(case):
    model, brute = case
    clean = model.clean(null_safe=False)
    expected = []
    for r in brute.clean:
        if r["InvoiceNo"] is None:
            r = {**r, "InvoiceDate": None, "CustomerID": None, "Country": None}
        if r["StockCode"] is None:
            r = {**r, "Description": None}
        expected.append(tuple(r[c] for c in clean.columns))
    assert sorted(rows(clean), key=repr) == sorted(expected, key=repr)


def test_sales(case):
    model, brute = case
    for got, want in (
        (rows(a.sales_by_region(model)), brute.sales("Region")),
        (rows(a.sales_by_country(model)), brute.sales("Country")),
    ):
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-15)
    assert rows(a.geo_sales(model)) == brute.geo_sales()


def test_tickets(case):
    model, brute = case
    assert rows(a.avg_ticket_by_country(model)) == brute.tickets()


def test_variety(case):
    model, brute = case
    assert rows(a.sku_by_region(model)) == brute.variety("Region", "StockCode")
    assert rows(a.sku_by_country(model)) == brute.variety("Country", "StockCode")
    assert rows(a.products_by_country(model)) == brute.variety("Geo", "StockCode")
    assert rows(a.customers_by_country(model)) == brute.variety("Geo", "CustomerID")


def test_known_customers_only(case):
    model, brute = case
    pairs = {(r["Geo"], r["CustomerID"]) for r in brute.clean}
    known = {g: len([1 for x, c in pairs if x == g and c is not None]) for g, _ in pairs}
    assert dict(rows(a.customers_by_country(model, include_null=False))) == known


def test_purchases(case):
    model, brute = case
    counts = brute.purchases()
    assert rows(a.mean_purchases(model)) == [(sum(counts.values()) / len(counts),)]
    known = {c: n for c, n in counts.items() if c is not None}
    assert rows(a.mean_purchases(model, include_null=False)) == [(sum(known.values()) / len(known),)]
    assert rows(a.purchases_per_customer(model)) == brute.report(known.items())


def test_prices(case):
    model, brute = case
    skus = ("85123A", "85099B", "22423")
    assert rows(a.price_by_region_sku(model)) == brute.prices(skus)
    assert rows(a.price_by_region_sku(model, limit=1)) == brute.prices(skus)[:1]


def test_list_countries(case):
    model, brute = case
    names = sorted({r["Country"] for r in brute.clean}, key=lambda c: (c is None, c or ""))
    assert [r[0] for r in rows(a.list_countries(model))] == names


@pytest.mark.parametrize("bins", [2, 30])
def test_histograms(case, bins):
    model, brute = case
    got = {(r[0], r[3]): r[4] for r in rows(a.hist_invoices_country(model, bins=bins))}
    assert got == brute.histogram(brute.invoices.values(), "Country", bins)
    got = {(r[0], r[3]): r[4] for r in rows(a.hist_lines_region(model, bins=bins))}
    assert got == brute.histogram(brute.clean, "Region", bins)


def test_dense_histogram(case):
    model, brute = case
    sparse = brute.histogram(brute.clean, "Region")
    got = {(r[0], r[3]): r[4] for r in rows(a.hist_lines_region(model, dense=True))}
    regions = {region for _, region in sparse}
    assert got == {(b, r): sparse.get((b, r), 0) for b in range(1, 31) for r in regions}


def test_stored_model_gives_the_same_reports(case, tmp_path):
    model, _ = case
    stored = model.store(str(tmp_path / "store"))
    assert sorted(rows(stored.clean()), key=repr) == sorted(rows(model.clean()), key=repr)
    assert sorted(rows(stored.invoices()), key=repr) == sorted(rows(model.invoices()), key=repr)
    for report in (
        a.sales_by_region, a.sku_by_country, a.avg_ticket_by_country, a.customers_by_country,
        a.price_by_region_sku, a.purchases_per_customer, a.list_countries,
    ):
        assert rows(report(stored)) == rows(report(model))


def test_empty_table(spark):
    model = Retail(frame(spark, TINY).where("false"))
    assert rows(a.sales_by_country(model)) == []
    assert rows(a.hist_lines_region(model)) == []
    assert rows(a.mean_purchases(model)) == [(None,)]
    assert rows(mean_count(count_by(model.lines, "Country"))) == [(None,)]
