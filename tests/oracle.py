"""Run registered queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, sf: str, con) -> str | None:
    """None when both results are equal, else what differs."""
    import __spark_entry__ as se

    df = se.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(se.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {str(bad[0])[:1500]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as se

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in se.queries():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            if name in se.oracle_sql():
                out = compare(spark, name, sf, con) or "ok"
            else:
                out = f"rows {se.queries()[name](spark, sf).count()}"
        except Exception as err:  # noqa: BLE001
            out = "ERROR " + str(err)[:900]
        print(f"{name:32s} {time.time() - t0:6.1f}s {out}", flush=True)
