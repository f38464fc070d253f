"""Run every query against its SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        try:
            return round(float(v), 6) + 0.0
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


_KIND = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool",
         "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool", "HUGEINT": "huge"}


def check(spark, con, name, run, sql, sf) -> tuple[str, float, float]:
    start = time.time()
    df = run(spark, sf)
    got = df.toPandas()
    spark_time, start = time.time() - start, time.time()
    if sql is None:
        return f"rows {len(got)}", spark_time, 0.0
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetch_df()
    sql_time = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} <> {sorted(want.columns)}", spark_time, sql_time
    mixed = {c: (t, types[c]) for c, t in df.dtypes if _KIND.get(t, t) != _KIND.get(types[c], types[c]) and not types[c].startswith("TIMESTAMP")}
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        only = sorted(set(a) - set(b), key=repr)[:3], sorted(set(b) - set(a), key=repr)[:3]
        return f"ROWS {len(a)} <> {len(b)}: spark only {only[0]} sql only {only[1]}", spark_time, sql_time
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(diff)} of {len(a)} differ: {sorted(got.columns)} {diff[:3]}", spark_time, sql_time
    return (f"ok {len(a)}" if len(a) else "EMPTY") + (f" TYPES {mixed}" if mixed else ""), spark_time, sql_time


def main() -> int:
    from pyspark.sql import SparkSession

    from checks import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in wanted:
        try:
            result, a, b = check(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
        except Exception as e:  # report and go on with the next query
            result, a, b = f"ERROR {type(e).__name__}: {str(e)[:400]}", 0.0, 0.0
        good = result.startswith(("ok", "rows")) and "TYPES" not in result
        bad += not good
        if not good or len(sys.argv) > 2:
            print(f"{name}: {result}", flush=True)
        print(f"  {name} {a:.1f}s {b:.1f}s", file=sys.stderr, flush=True)
    print(f"{len(wanted)} queries, {bad} to look at")
    spark.stop()
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
