"""Scans with column pruning and pushed filters, and loading as a table kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from staygrid.functions.times import floor_to, seconds_between
from staygrid.operators.ids import convert_id
from staygrid.operators.select import Filter, apply_filters, select_ids
from staygrid.schema import HOUR, Table, names


def read_parquet(
    spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, filters: list[Filter] | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """One or many parquet files or folders; pruning and skipping are left to the scan."""
    reader = spark.read.option("mergeSchema", "true") if merge_schema else spark.read
    df = apply_filters(reader.parquet(*names(paths)), *(filters or []))
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: str, columns: list[str] | None = None,
    filters: list[Filter] | None = None, sep: str = ",",
) -> DataFrame:
    """Plain or gzipped CSV with a declared schema."""
    df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(names(paths))
    df = apply_filters(df, *(filters or []))
    return df.select(*columns) if columns else df


def load_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[Filter] | None = None,
    wanted: DataFrame | None = None, on: str | list[str] | None = None,
    stays: DataFrame | None = None, hospital_id: str | None = None, stay_id: str | None = None,
) -> DataFrame:
    """A source table: pruned, filtered, restricted to wanted ids, with the stay id added.

    Hospital-level tables get their stay id from the ``stays`` table.
    """
    df = read_parquet(spark, path, columns, filters)
    if stays is not None and stay_id not in df.columns:
        df = df.join(stays.select(hospital_id, stay_id).distinct(), hospital_id)
    return df if wanted is None else select_ids(df, wanted, on)


def metadata(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns, and the schema text."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "n_columns": F.lit(len(df.columns)), "schema": F.lit(df.schema.simpleString()),
    })


def peek(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def load_src(df: DataFrame, rows: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    df = df if rows is None else df.where(rows)
    return df.select(*columns) if columns else df


def load_difftime(df: DataFrame, origin: DataFrame, ids: list[str], origin_time: str, times: list[str]) -> DataFrame:
    """Timestamps as whole seconds since the id's origin."""
    joined = df.join(origin.select(*ids, F.col(origin_time).alias("_origin")), ids, "left")
    return joined.withColumns({t: seconds_between("_origin", t) for t in times}).select(*df.columns)


def load_id(df: DataFrame, ids: list[str], columns: list[str], mapping: DataFrame | None = None, to_id: str | None = None) -> Table:
    """Rows keyed by id, converted to another id system if asked for."""
    out = df.select(*ids, *columns)
    if mapping is not None:
        return Table(convert_id(out, mapping, ids[0], to_id), (to_id,))
    return Table(out.dropna(subset=ids), tuple(ids))


def load_ts(
    df: DataFrame, ids: list[str], time: str, columns: list[str], interval: int = HOUR,
    origin: DataFrame | None = None, origin_time: str | None = None,
) -> Table:
    """Rows keyed by id and floored time."""
    rows = df.select(*ids, time, *columns).dropna(subset=ids)
    if origin is not None:
        rows = load_difftime(rows, origin, ids, origin_time, [time])
    return Table(rows.withColumn(time, floor_to(time, interval)), tuple(ids), time, interval=interval)


def load_win(
    df: DataFrame, ids: list[str], start: str, end: str, columns: list[str], interval: int = HOUR,
    origin: DataFrame | None = None, origin_time: str | None = None, dur: str = "dur",
) -> Table:
    """Windows keyed by id and floored start, with their duration."""
    rows = df.select(*ids, start, end, *columns).dropna(subset=ids)
    if origin is not None:
        rows = load_difftime(rows, origin, ids, origin_time, [start, end])
    rows = rows.withColumn(dur, F.col(end) - F.col(start)).drop(end).withColumn(start, floor_to(start, interval))
    return Table(rows, tuple(ids), start, dur, interval=interval)


TableReader = Callable[[str], DataFrame]


def folder(spark: SparkSession, root: str) -> TableReader:
    """Reader of the parquet tables in one folder, by name."""
    return lambda name: spark.read.parquet(f"{root}/{name}.parquet")
