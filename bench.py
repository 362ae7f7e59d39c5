"""Time every named analysis and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the local cores. Each analysis runs twice from the raw lines, all rows of them and the
attributes it reads, and all rows of its result are produced; "queries" holds the second run, "cold" the
first. "shapes" times the heavy queries behind them (the cleaned table, joins, distinct rows).
"stored" times the same analyses on a model written once ("store_sec") and removed at the end, and
"stored_approx" the distinct counts by sketches. "calibration_sec" is the median of five runs of a plain
aggregate over numbers, which tells machines apart. "first_rows" alternates, five times each, the ways to
find the first line of each invoice (medians).
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark
from pyspark.sql import functions as F

from tillroll.driver.adapter import MAP_NAMES, REGIONS, numbered_raw, retail, written
from tillroll.driver.queries import ANALYSES, QUERIES
from tillroll.operators.keyed import first_by_key
from tillroll.plans import analyses
from tillroll.plans.retail import invoice_sums, valid_lines
from tillroll.schema import INVOICE_COLUMNS, ROW_ORDER
from tillroll.session import local_session, scratch_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SHAPES = ("clean_retail", "join_invoices", "join_products", "join_boundaries", "distinct_multi")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def calibration(spark) -> float:
    """Seconds for an aggregate that no change of this library touches."""
    numbers = lambda: run(spark.range(200_000_000).selectExpr("sum(id % 7) AS a", "max(hash(id)) AS b"))
    return statistics.median(timed(numbers) for _ in range(5))


def first_rows(spark) -> dict[str, float]:
    """One aggregate of a struct, the same after hashing by invoice and attributes, and the lowest
    number by hash with a join of the line it stands for."""
    lines = valid_lines(numbered_raw(spark, SF_DIR).withColumnRenamed("line_no", ROW_ORDER))
    path = written(lines)
    lines = spark.read.parquet(path)
    key, values = "InvoiceNo", INVOICE_COLUMNS

    def hashed_first():
        fewer = lines.groupBy(key, *values).agg(F.min(ROW_ORDER).alias(ROW_ORDER), *invoice_sums())
        sums = [F.sum(c).alias(c) for c in ("total", "n_lines")]
        return first_by_key(fewer, key, values, ROW_ORDER, sums)

    def joined():
        lowest = lines.groupBy(key).agg(F.min(ROW_ORDER).alias(ROW_ORDER), *invoice_sums())
        return lowest.join(lines.select(ROW_ORDER, *values), ROW_ORDER)

    ways = {
        "struct": lambda: first_by_key(lines, key, values, ROW_ORDER, invoice_sums()),
        "hashed_first": hashed_first,
        "joined": joined,
    }
    took = [{name: timed(lambda: run(way())) for name, way in ways.items()} for _ in range(6)][1:]
    return {name: statistics.median(t[name] for t in took) for name in ways}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session("tillroll-bench", CPUS)
    scratch_folder(spark)  # where the stored model will be
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    cold, warm = (
        {name: timed(lambda: run(QUERIES[name](spark, SF_DIR))) for name in ANALYSES} for _ in range(2)
    )
    shapes = {name: timed(lambda: run(QUERIES[name](spark, SF_DIR))) for name in SHAPES}
    models = []
    store = timed(lambda: models.append(retail(spark, SF_DIR).store()))
    stored = {
        name: timed(lambda: run(analysis(models[0], spark, SF_DIR)))
        for name, (_, analysis) in ANALYSES.items()
    }
    approx = {
        "sku_by_country": lambda: analyses.sku_by_country_approx(models[0]),
        "sku_by_region": lambda: analyses.sku_by_region_approx(models[0], REGIONS),
        "customers_by_country": lambda: analyses.customers_by_country_approx(models[0], MAP_NAMES),
    }
    approx = {name: timed(lambda: run(analysis())) for name, analysis in approx.items()}
    models[0].remove()
    total = sum(warm.values())
    print(
        json.dumps(
            {
                "metric": "retail_analyses_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cold": cold,
                "shapes": shapes,
                "store_sec": store,
                "stored": stored,
                "stored_total": round(sum(stored.values()), 3),
                "stored_approx": approx,
                "first_rows": first_rows(spark),
                "calibration_sec": calibration(spark),
                "input_lines": lines,
                "lines_per_sec": round(lines * len(warm) / total),
                "spark": pyspark.__version__,
                "cpus": CPUS,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
