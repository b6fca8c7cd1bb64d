"""Compare every query with its SQL: ``python -m parity.check [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from parity.oracles import ORACLES
from parity.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, every value as text."""
    def text(value) -> str:
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return "NULL"
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        return str(value)

    out = frame[sorted(frame.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when equal."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(set(spark_frame.columns) ^ set(sql_frame.columns))}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = normal(spark_frame), normal(sql_frame)
    wrong = (a != b).any(axis=1)
    if not wrong.any():
        return ""
    columns = [c for c in a.columns if (a[c] != b[c]).any()]
    i = int(wrong.to_numpy().argmax())
    return f"{int(wrong.sum())} rows differ in {columns[:6]}: {a.loc[i, columns[:4]].tolist()} != {b.loc[i, columns[:4]].tolist()}"


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            found = difference(got, connection.execute(ORACLES[name]).df()) if name in ORACLES else "no SQL"
            rows = len(got)
        except Exception as error:  # report and go on with the next query
            found, took, rows = f"{type(error).__name__}: {str(error)[:400]}", time.time() - start, -1
        failures += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} rows={rows} {took:.1f}s {found}", flush=True)
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    raise SystemExit(min(main(arguments[0], arguments[1:]), 1))
