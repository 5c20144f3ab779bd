"""Compare registered queries with their SQL in DuckDB: ``python -m quantloom.checks.compare``."""

from __future__ import annotations

import re
import sys
import time

import duckdb
import numpy as np
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(path: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def _rows(pdf, cols):
    def norm(v):
        if v is None or v is np.nan or (isinstance(v, float) and np.isnan(v)):
            return "\0"
        if isinstance(v, (list, np.ndarray)):
            return str([norm(x) for x in v])
        if hasattr(v, "isoformat"):
            return v.isoformat()[:26].replace("T00:00:00", "")
        return str(float(v)) if isinstance(v, (float, np.floating)) else str(v)
    return sorted("\1".join(norm(v) for v in row) for row in
                  zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in cols]))


def compare(spark: SparkSession, con, path: str, name: str, run, sql: str | None) -> str:
    t = time.time()
    got = run(spark, path).toPandas()
    spent = time.time() - t
    if sql is None:
        return f"rows  {name} {len(got)} rows {spent:.2f}s"
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL  {name} columns {sorted(set(got.columns) ^ set(want.columns))}"
    cols = sorted(got.columns)
    if len(got) != len(want):
        return f"FAIL  {name} rows {len(got)} vs {len(want)}"
    a, b = _rows(got, cols), _rows(want, cols)
    if a != b:
        bad = []
        keys = [c for c in cols if got[c].dtype == object or "datetime" in str(got[c].dtype)]
        for c in cols:
            x, y = _rows(got, keys + [c]), _rows(want, keys + [c])
            n = sum(p != q for p, q in zip(x, y))
            if n:
                first = next((p, q) for p, q in zip(x, y) if p != q)
                bad.append(f"{c}:{n} {first}")
        return f"FAIL  {name} values " + "; ".join(bad)[:3000].replace("\1", "|").replace("\0", "∅")
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in cols
             if str(got[c].dtype)[:3] != str(want[c].dtype)[:3]]
    return f"ok    {name} {len(got)} rows {spent:.2f}s {types if types else ''}"


def main(argv: list[str]) -> None:
    from quantloom.checks import QUERIES, SQL
    path = "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    wanted = [n for n in QUERIES if not argv or any(re.fullmatch(a, n) for a in argv)]
    for name in wanted:
        try:
            print(compare(spark, con, path, name, QUERIES[name], SQL.get(name)), flush=True)
        except Exception as e:  # report and go on
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
