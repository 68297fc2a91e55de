"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if (Path(sf) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        v = round(float(v), 9)
        return int(v) if v.is_integer() else v
    return str(v)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(_plain(v) for v in row) for row in pdf.itertuples(index=False)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for a, b in zip(_rows(got), _rows(want)):
        if a != b:
            return f"{sorted(got.columns)}: {a} != {b}"
    return None


def main(sf: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    from . import ORACLES, QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            took = time.time() - start
            start = time.time()
            if name in ORACLES:
                problem = difference(got, con.execute(ORACLES[name]).df())
                verdict = problem or "same"
            else:
                problem, verdict = (None if len(got) else "no rows"), f"rows {len(got)}"
            print(f"{'BAD ' if problem else 'ok  '} {name} {took:.1f}s/{time.time() - start:.1f}s {verdict[:600]}", flush=True)
        except Exception as e:  # report and go on with the next query
            problem = True
            print(f"FAIL {name} {type(e).__name__} {str(e)[:900]}", flush=True)
        bad += bool(problem)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
