import csv
from datetime import datetime
from decimal import Decimal

import pytest
from data import D1, SCHEMA, TINY, Brute, frame, line, random_rows
from pyspark.sql import functions as F

from tillroll import (
    Retail,
    country_sales_export,
    locate,
    read_boundaries,
    read_gazetteer,
    read_retail,
    write_country_sales,
)
from tillroll.plans import analyses as a
from tillroll.schema import BOUNDARY_SCHEMA, RETAIL_SCHEMA, ROW_ORDER

# Sales per country that the export must reproduce, high to low.
COUNTRY_SALES = """\
Country,Ventas Totales
UK,9045672.524
Netherlands,285446.34
Ireland,283453.96
Germany,228867.14
France,209715.11
Australia,138521.31
Spain,61577.11
Switzerland,57089.9
Belgium,41196.34
Sweden,38378.33
Japan,37416.37
Norway,36165.44
Portugal,33747.1
Finland,22546.08
Singapore,21279.29
Denmark,18955.34
Italy,17483.24
China,15691.8
Cyprus,13590.38
Austria,10198.68
Israel,8135.26
Poland,7334.65
Greece,4760.52
Unspecified,4749.79
Iceland,4310
Canada,3666.38
USA,3580.39
Malta,2725.59
United Arab Emirates,1902.28
Lebanon,1693.88
Lithuania,1661.06
European Community,1300.25
Brazil,1143.6
South Africa,1002.31
Czech Republic,826.74
Bahrain,754.14
Saudi Arabia,145.92
"""


def rows(df):
    return [tuple(r) for r in df.collect()]


def lines_for_country_sales():
    """Invoice lines, under the shops' own country names, that add up to COUNTRY_SALES."""
    own = {"Ireland": "EIRE", "South Africa": "RSA", "China": "Hong Kong"}
    for i, row in enumerate(csv.DictReader(COUNTRY_SALES.splitlines())):
        name, total = row["Country"], Decimal(row["Ventas Totales"])
        if name == "UK":
            yield line("uk1", "S", "d", 1, D1, total - 30000, "c", "United Kingdom")
            yield line("uk2", "S", "d", 2, D1, "15000", "c", "Channel Islands")
        else:
            yield line(str(i), "S", "d", 1, D1, total, "c", own.get(name, name))


def test_export_reproduces_the_published_sales(spark, tmp_path):
    model = Retail(frame(spark, list(lines_for_country_sales()), 5))
    out = tmp_path / "export"
    write_country_sales(a.country_sales(model), str(out))
    files = sorted(out.glob("part-*.csv"))
    assert len(files) == 1
    assert files[0].read_text() == COUNTRY_SALES


def test_published_shares(spark):
    model = Retail(frame(spark, list(lines_for_country_sales())))
    regions = {r.Region: r for r in a.sales_by_region(model).collect()}
    assert sum(r.total_invoice for r in regions.values()) == pytest.approx(10666684.544)
    assert round(regions["Western Europe"].porcentage, 4) == 0.9302
    assert a.geo_sales(model).count() == 37


def test_export_frame(spark):
    sales = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 20000000.5)], "Country string, total_invoice double")
    shown = country_sales_export(sales)
    assert shown.columns == ["Country", "Ventas Totales"]
    assert rows(shown) == [("c", 20000000.5), ("a", 1.0), ("b", 1.0)]


def write_csv(path, data, names=RETAIL_SCHEMA.names):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(names)
        out.writerows([["" if v is None else v for v in r] for r in data])


def test_csv_first_rows_follow_the_file_whatever_the_splits(spark, tmp_path):
    data = random_rows(5, 3000)
    write_csv(tmp_path / "a.csv", data[:1000])
    write_csv(tmp_path / "b.csv", data[1000:])
    expected = Brute(data)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, splits in (("128m", 1), ("4k", 30)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = read_retail(spark, str(tmp_path), "csv")
            assert raw.select(F.spark_partition_id()).distinct().count() >= splits
            assert raw.columns == [*RETAIL_SCHEMA.names, ROW_ORDER]
            model = Retail(raw)
            assert {r[0]: r[1:] for r in rows(model.invoices())} == {
                k: (i["InvoiceDate"], i["CustomerID"], i["Country"]) for k, i in expected.invoices.items()
            }
            assert dict(rows(model.products())) == expected.products
            assert rows(a.geo_sales(model)) == expected.geo_sales()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_csv_must_match_the_schema(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write_csv(tmp_path / "x" / "a.csv", [], ["Invoice", *RETAIL_SCHEMA.names[1:]])
    with open(tmp_path / "x" / "a.csv", "a") as f:
        f.write("1,s,d,1,2011-01-01 00:00:00,1.0,c,UK\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_retail(spark, str(tmp_path / "x"), "csv").collect()
    (tmp_path / "y").mkdir()
    write_csv(tmp_path / "y" / "a.csv", [line("1", "s", "d", "many", "2011-01-01 00:00:00", 1, "c", "UK")])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_retail(spark, str(tmp_path / "y"), "csv").collect()


def test_csv_timestamp_format(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [line("1", "s", "d", 1, "12/1/2010 8:26", 1, "c", "UK")])
    raw = read_retail(spark, str(tmp_path), "csv", timestamp_format="M/d/yyyy H:mm")
    assert raw.first().InvoiceDate == datetime(2010, 12, 1, 8, 26)


@pytest.mark.parametrize("files", [1, 4])
def test_parquet_first_rows_follow_the_files(spark, tmp_path, files):
    data = random_rows(6, 800)
    df = frame(spark, data).drop(ROW_ORDER)
    df.coalesce(1).write.option("maxRecordsPerFile", 800 // files).parquet(str(tmp_path / "t"))
    model = Retail(read_retail(spark, str(tmp_path / "t")))
    expected = Brute(data)
    assert dict(rows(model.products())) == expected.products
    assert rows(a.sales_by_country(model))[0][0] == expected.sales("Country")[0][0]
    assert rows(a.avg_ticket_by_country(model)) == expected.tickets()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sequence_column(spark, tmp_path, fmt):
    df = frame(spark, TINY).withColumnRenamed(ROW_ORDER, "row_id")
    df = df.select("row_id", *RETAIL_SCHEMA.names).orderBy(F.desc("row_id")).coalesce(1)
    path = str(tmp_path / "t")
    df.write.option("header", True).format(fmt).save(path)
    raw = read_retail(spark, path, fmt, sequence="row_id")
    assert raw.schema[ROW_ORDER].dataType == SCHEMA[ROW_ORDER].dataType
    assert dict(rows(Retail(raw).products())) == Brute(TINY).products


def test_parquet_must_match_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, TINY).withColumn("UnitPrice", F.col("UnitPrice").cast("double")).drop("Country").write.parquet(path)
    with pytest.raises(ValueError, match="UnitPrice: expected decimal.*found double.*Country.*no such column"):
        read_retail(spark, path)
    with pytest.raises(ValueError, match="unknown format"):
        read_retail(spark, path, "xlsx")


def other_types(spark):
    other = {"Quantity": "bigint", "UnitPrice": "double", "CustomerID": "double"}
    rows_ = [("1", "s", "d", 3, D1, 2.55, 17850.0, "UK"), ("2", "s", None, None, None, None, None, None)]
    kinds = [f"{f.name} {other.get(f.name, f.dataType.simpleString())}" for f in RETAIL_SCHEMA]
    return spark.createDataFrame(rows_, ", ".join(kinds))


def test_conversion_on_request(spark, tmp_path):
    path = str(tmp_path / "t")
    other_types(spark).write.parquet(path)
    with pytest.raises(ValueError, match="Quantity: expected int, found bigint"):
        read_retail(spark, path)
    lines = read_retail(spark, path, convert=True).drop(ROW_ORDER)
    assert [f.dataType for f in lines.schema] == [f.dataType for f in RETAIL_SCHEMA]
    assert sorted(rows(lines)) == [
        ("1", "s", "d", 3, D1, Decimal("2.550"), "17850", "UK"),
        ("2", "s", None, None, None, None, None, None),
    ]


@pytest.mark.parametrize(
    "column, value",
    [("Quantity", "3000000000L"), ("UnitPrice", "2.5555D"), ("UnitPrice", "1e12D"), ("UnitPrice", "double('NaN')"), ("CustomerID", "17850.5D")],
)
def test_inexact_values_are_not_converted(spark, tmp_path, column, value):
    path = str(tmp_path / "t")
    other_types(spark).withColumn(column, F.expr(value)).write.parquet(path)
    with pytest.raises(Exception, match=f"{column} can't be"):
        read_retail(spark, path, convert=True).collect()


def test_a_string_is_not_converted(spark, tmp_path):
    path = str(tmp_path / "t")
    other_types(spark).withColumn("UnitPrice", F.lit("2.5")).write.parquet(path)
    with pytest.raises(ValueError, match="UnitPrice: expected decimal.*found string"):
        read_retail(spark, path, convert=True)


@pytest.mark.parametrize("country", ["UK", None])
def test_gazetteer_holds_a_country_once(spark, tmp_path, country):
    places = spark.createDataFrame([(country, 1.0, 2.0), (country, 3.0, 4.0), ("x", 1.0, 2.0)], "Country string, lon double, lat double")
    places.write.parquet(str(tmp_path / "g"))
    with pytest.raises(ValueError, match="Country must be unique"):
        read_gazetteer(spark, str(tmp_path / "g"))


def test_stored_model_can_be_removed(spark, tmp_path):
    folder = tmp_path / "model"
    model = Retail(frame(spark, TINY)).store(str(folder))
    (folder / "note").write_text("not the model's")
    assert model.clean().count()
    model.remove()
    assert sorted(p.name for p in folder.iterdir()) == ["note"]
    other = Retail(frame(spark, TINY)).store(str(tmp_path / "other"))
    other.remove()
    assert not (tmp_path / "other").exists()


def test_a_cluster_refuses_local_folders(spark, tmp_path, monkeypatch):
    from tillroll import session

    monkeypatch.setattr(session, "is_local", lambda spark: False)
    with pytest.raises(ValueError, match="local folder"):
        session.require_reachable(spark, str(tmp_path))
    below = f"{session.shared_folder(spark)}/model"
    assert session.require_reachable(spark, below) == below


def test_boundaries_and_gazetteer(spark, tmp_path):
    bounds = spark.createDataFrame([(1.0, 2.0, 1, 1, "UK", None)], BOUNDARY_SCHEMA)
    bounds.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "b"))
    assert rows(read_boundaries(spark, str(tmp_path / "b"))) == [(1.0, 2.0, 1, 1, "UK", None)]
    places = spark.createDataFrame([("UK", -2.0, 54.0)], "Country string, lon double, lat double")
    places.write.parquet(str(tmp_path / "g"))
    gazetteer = read_gazetteer(spark, str(tmp_path / "g"))
    sales = spark.createDataFrame([("UK", 5), ("Mu", 1)], "Country string, n int")
    located = locate(sales, gazetteer, "table")
    assert located.columns == ["Country", "n", "coord", "source"]
    got = {r.Country: (r.coord.lon, r.coord.lat, r.source) for r in located.collect()}
    assert got == {"UK": (-2.0, 54.0, "table"), "Mu": (None, None, "table")}
    with pytest.raises(ValueError):
        read_boundaries(spark, str(tmp_path / "g"))
