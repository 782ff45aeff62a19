"""Run registered queries in Spark and their oracle in DuckDB and compare.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return x


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(_cell(x) for x in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    """None when both hold the same columns, kinds and exact values."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    for c in spark_pdf.columns:
        a, b = spark_pdf[c].dtype, duck_pdf[c].dtype
        if a != b:
            return f"type of {c}: {a} != {b}"
    for a, b in zip(_rows(spark_pdf), _rows(duck_pdf)):
        if a != b:
            return f"values {a} != {b}"
    return None


def main() -> int:
    from checks import CHECKS, spark_query
    from tonecast.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CHECKS)
    spark = build_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                            "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = spark_query(name)(spark, sf_dir).toPandas()
            took = time.time() - start
            sql = CHECKS[name].sql
            problem = difference(got, con.execute(sql).df()) if sql else None
            state = ("rows only" if not sql else "ok") if problem is None else f"DIFF {problem[:1500]}"
        except Exception as e:
            took, problem, state = time.time() - start, "error", f"ERROR {type(e).__name__}: {str(e)[:900]}"
            got = []
        bad += problem is not None
        print(f"{name:34s} {took:6.2f}s {len(got):7d} rows  {state}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
