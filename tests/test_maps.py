import pytest
from data import TINY, Brute, frame, random_rows

from tillroll.plans import maps
from tillroll.plans.retail import Retail
from tillroll.schema import BOUNDARY_SCHEMA

# Ireland has two outlines; Nowhere has no sales; Japan and Atlantis have no outline.
OUTLINES = ["UK", "Ireland", "Ireland", "China", "Germany", "France", "Spain", "Nowhere"]


@pytest.fixture(scope="module")
def boundaries(spark):
    vertices = [
        (float(g + v), float(v), g, 3 * g + v, name, None)
        for g, name in enumerate(OUTLINES)
        for v in range(3)
    ]
    return spark.createDataFrame(vertices, BOUNDARY_SCHEMA)


@pytest.fixture(scope="module")
def gazetteer(spark):
    places = [(n, float(i), -float(i)) for i, n in enumerate(dict.fromkeys(OUTLINES)) if n != "China"]
    return spark.createDataFrame(places, "Country string, lon double, lat double")


@pytest.fixture(scope="module", params=["tiny", "random"])
def case(request, spark):
    rows = TINY if request.param == "tiny" else random_rows(3)
    return Retail(frame(spark, rows, 3)), Brute(rows)


def check(got, boundaries, measure):
    """Vertices of countries with a measure, each with its values."""
    values = {m[0]: m[1:] for m in measure}
    expected = [(*v, *values[v["region"]]) for v in boundaries.collect() if v["region"] in values]
    assert got.columns[:6] == BOUNDARY_SCHEMA.names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def coded(measure):
    drawn = [m for m in measure if m[0] in OUTLINES]
    counts = sorted({n for _, n in drawn})
    return [(c, n, counts.index(n) + 1) for c, n in drawn]


def test_outline_maps(case, boundaries):
    model, brute = case
    check(maps.map_total_sales(model, boundaries), boundaries, brute.geo_sales())
    check(maps.map_avg_ticket(model, boundaries), boundaries, brute.tickets())


def test_category_maps(case, boundaries):
    model, brute = case
    check(maps.map_customers(model, boundaries), boundaries, coded(brute.variety("Geo", "CustomerID")))
    check(maps.map_products(model, boundaries), boundaries, coded(brute.variety("Geo", "StockCode")))


@pytest.mark.parametrize("measure", list(maps.POINT_MEASURES))
def test_points(case, gazetteer, measure):
    model, brute = case
    values = {
        "products": lambda: brute.variety("Geo", "StockCode"),
        "avg_ticket": brute.tickets,
        "customers": lambda: brute.variety("Geo", "CustomerID"),
        "total_sales": brute.geo_sales,
    }[measure]()
    places = {r.Country: (r.lon, r.lat) for r in gazetteer.collect()}
    expected = [(c, *places.get(c, (None, None)), float(v), "gazetteer") for c, v in values]
    got = maps.geo_point_series(model, gazetteer, measure)
    assert got.columns == ["Country", "lon", "lat", "measure", "source"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_customer_scatter(case):
    model, brute = case
    known = {c: n for c, n in brute.purchases().items() if c is not None}
    assert dict(map(tuple, maps.customer_scatter_series(model).collect())) == known
