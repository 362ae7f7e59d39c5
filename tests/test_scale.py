"""Work that must not pile up as the input grows."""

import threading
from datetime import datetime

import pytest
from data import frame, random_rows
from pyspark.sql import functions as F

from tillroll import Retail
from tillroll.driver import queries
from tillroll.llm import tokens
from tillroll.session import at_once


@pytest.fixture
def star(spark, tmp_path):
    """Star tables of 1,200 lines, all of one part, in six files of lines."""
    day = datetime(2011, 1, 4)
    lines = [(i // 4, 1, i % 3, i % 4 + 1, 2.0, 5.0 + i, 0.0, 0.1, "N", "O", day) for i in range(1200)]
    tables = {
        "lineitem": (
            lines,
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
            " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
            " l_shipdate timestamp_ntz",
        ),
        "orders": ([(i, i % 7) for i in range(300)], "o_orderkey bigint, o_custkey bigint"),
        "part": ([(1, "RED BOLT", "BRAND#1", "STEEL")], "p_partkey bigint, p_name string, p_brand string, p_type string"),
        "supplier": ([(i, i) for i in range(3)], "s_suppkey bigint, s_nationkey int"),
        "nation": ([(i, f"NATION_{i}") for i in range(3)], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema).repartition(6 if name == "lineitem" else 1)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_dense_scan_of_one_product_deals_its_lines(spark, star, monkeypatch):
    """Files of even size, more of them with more input; by product they were five, one with all lines."""
    paths = []
    write = queries.written
    monkeypatch.setattr(queries, "written", lambda *args: paths.append(write(*args)) or paths[-1])
    found = queries.scan_retail_dense(spark, star).collect()
    assert [tuple(r) for r in found] == [(1200, 0, 1199, 1200)]
    sizes = [r["count"] for r in spark.read.parquet(paths[0]).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 100


def counting(spark, df):
    """``df``, and how many of its rows have been read."""
    read = spark.sparkContext.accumulator(0)

    def seen(quantity):
        read.add(1)
        return quantity

    seen = F.udf(seen, "int").asNondeterministic()
    return df.withColumn("Quantity", seen("Quantity")), read


def test_loads_are_read_four_times(spark, tmp_path):
    """For facts, products, the cleaned table and the last number; products were read three times more for their codes."""
    raw, read = counting(spark, frame(spark, random_rows(51, 300)))
    model = Retail(raw).store(str(tmp_path / "m"))
    assert read.value == 4 * 300
    raw, read = counting(spark, frame(spark, random_rows(52, 200)))
    model.add(raw)
    assert read.value == 4 * 200


def test_bitmaps_are_made_of_pairs(spark, tmp_path):
    """Spark sorts for a bitmap; it sorts the different products of a country, not the lines."""
    data = random_rows(53, 400)
    model = Retail(frame(spark, data)).store(str(tmp_path / "m"))
    pairs = model.clean().select("Country", "StockCode").distinct().count()
    assert model.table("sold").count() == pairs < model.clean().count()
    more = model.add(frame(spark, data))
    assert more.table("sold").count() == pairs


def test_jobs_at_once(spark):
    """Each waits for the other; properties of the caller hold; an error is raised."""
    both = threading.Barrier(2, timeout=60)
    spark.sparkContext.setLocalProperty("tillroll.test", "here")

    def job(name):
        both.wait()
        return name, spark.sparkContext.getLocalProperty("tillroll.test")

    assert at_once(spark, lambda: job("a"), lambda: job("b")) == [("a", "here"), ("b", "here")]
    spark.sparkContext.setLocalProperty("tillroll.test", None)
    with pytest.raises(ZeroDivisionError):
        at_once(spark, lambda: 1 / 0, lambda: 2)


def test_words_of_a_large_vocabulary_stay_known(monkeypatch):
    """300,000 different words are encoded once; with more than 250,000 a worker forgot them all."""
    words = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [" ".join(f"w{i}" for i in range(k, k + 100_000)) for k in range(0, 300_000, 100_000)]
    first = [words.encode_many([t])[0].tolist() for t in texts]
    words.encode_many(["one more"])
    monkeypatch.setattr(words, "_learn", lambda new: pytest.fail(f"{len(new)} words are new"))
    assert [words.encode_many([t])[0].tolist() for t in texts] == first
