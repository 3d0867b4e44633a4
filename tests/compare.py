"""Run queries and their SQL side by side: python -m tests.compare [folder] [name ...] [setting=value ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (bool, str)):
            return v
        return round(float(v), 6)

    columns = [[plain(v) for v in df[c].astype(object)] for c in sorted(df.columns)]
    return sorted(zip(*columns), key=repr)


def difference(spark, con, folder: str, name: str) -> str | None:
    got = entry.queries()[name](spark, folder).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns)
        if got[c].notna().all() and got[c].dtype != want[c].dtype
    ]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got.columns)}, first {bad[0]}"
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = [n for n in sys.argv[2:] if "=" not in n] or list(entry.oracle_sql())
    settings = [n.split("=", 1) for n in sys.argv[2:] if "=" in n]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in settings:
        spark.conf.set(key, value)
    con = duck(folder)
    for n in names:
        t = time.time()
        try:
            result = difference(spark, con, folder, n)
        except Exception as e:  # report and go on with the next query
            result = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{n:26s} {time.time() - t:6.1f}s  {result or 'ok'}", flush=True)
