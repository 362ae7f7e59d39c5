"""Compare every query with its SQL on DuckDB: python tests/oracle_check.py SF_DIR [QUERY ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=0.0)
    return type(a) is type(b) and a == b


def difference(df, con, sql) -> str | None:
    """None if the two results hold the same rows, else what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} / {names}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows / {len(expected)} rows"
    for g, e in zip(got, expected):
        if not all(same(x, y) for x, y in zip(g, e)):
            return f"{g} / {e}"
    return None


if __name__ == "__main__":
    from tillroll.driver.oracle import ORACLE
    from tillroll.driver.queries import QUERIES
    from tillroll.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con, bad = local_session("oracle-check"), connect(sf_dir), 0
    for name in chosen or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            wrong = difference(df, con, ORACLE[name])
            n = df.count()
        except Exception as e:
            wrong, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += wrong is not None
        print(f"{name:32s} {'ok' if wrong is None else 'DIFF ' + wrong}  rows={n} {time.time() - start:.1f}s", flush=True)
    sys.exit(bad > 0)
