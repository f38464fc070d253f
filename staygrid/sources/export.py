"""Sinks: per-patient text files, wide and long text, summaries, columnar files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from staygrid.operators import quality, stats
from staygrid.operators.grid import fill_gaps
from staygrid.operators.slices import time_slice, totals
from staygrid.schema import HOUR

TASKS = 4  # tasks for each core where folders are listed
LISTINGS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def psv_rows(df: DataFrame, id_col: str, time: str, na_rows: bool | None = None) -> DataFrame:
    """Rows as written by ``write_psv``: hours since the id's first time.

    ``na_rows`` true fills the hourly grid, false drops rows without data.
    """
    if na_rows is True:
        df = fill_gaps(df, [id_col], time, HOUR)
    elif na_rows is False:
        df = df.dropna("all", subset=[c for c in df.columns if c not in (id_col, time)])
    first = totals(df, [id_col], {"_first": F.min(time)})
    return first.withColumn(time, (F.col(time) - F.col("_first")) / HOUR).drop("_first").select(*df.columns)


def write_psv(df: DataFrame, target: str, id_col: str, time: str, na_rows: bool | None = None, mode: str = "overwrite") -> None:
    """Pipe-separated text, one folder per patient; a long stay is split over files."""
    rows = psv_rows(df, id_col, time, na_rows).withColumn("_part", time_slice(F.col(time) * HOUR, 30 * 24 * HOUR))
    rows.repartition(id_col, "_part").sortWithinPartitions(id_col, time).drop("_part").write.mode(mode).partitionBy(
        id_col
    ).option("sep", "|").option("header", True).option("nullValue", "NaN").csv(target)


@contextmanager
def _few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks for each core, not by a task for each folder."""
    before = spark.conf.get(LISTINGS, None)
    spark.conf.set(LISTINGS, str(TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LISTINGS) if before is None else spark.conf.set(LISTINGS, before)


def read_psv(spark: SparkSession, path: str, schema: str, id_col: str = "id", flat: bool = False) -> DataFrame:
    """Per-patient text back into one table.

    The id comes from the folder, or with ``flat`` from files named ``p<id>.psv``.
    """
    reader = spark.read.option("sep", "|").option("header", True).option("nullValue", "NaN")
    if not flat:
        with _few_listings(spark):
            return reader.schema(f"{schema}, {id_col} bigint").csv(path)
    named = reader.schema(schema).option("pathGlobFilter", "*.psv").csv(path)
    return named.withColumn(id_col, F.regexp_extract(F.input_file_name(), r"p?(\d+)\.psv$", 1).cast("bigint"))


def write_wide(df: DataFrame, target: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", "NA").csv(target)


def long_rows(df: DataFrame, ids: list[str], time: str, columns: list[str]) -> DataFrame:
    """(id, t, variable, value) without missing values."""
    typed = df.select(*ids, time, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([*ids, time], columns, "variable", "value").dropna(subset=["value"])


def write_long(df: DataFrame, target: str, ids: list[str], time: str, columns: list[str], sep: str = ",", mode: str = "overwrite") -> None:
    long_rows(df, ids, time, columns).write.mode(mode).option("header", True).option("sep", sep).csv(target)


def write_summary(df: DataFrame, target: str, columns: list[str], mode: str = "overwrite") -> None:
    stats.summary(df, columns).write.mode(mode).option("header", True).csv(target)


def write_cohort_info(df: DataFrame, target: str, ids: list[str], time: str | None = None, mode: str = "overwrite") -> None:
    quality.cohort_info(df, ids, time).write.mode(mode).option("header", True).csv(target)


def write_quality_report(df: DataFrame, target: str, keys: list[str] | None = None, mode: str = "overwrite") -> None:
    quality.column_report(df, keys).write.mode(mode).option("header", True).csv(target)


def export(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Any Spark file format: parquet, json, csv, orc."""
    if fmt == "csv":
        options.setdefault("header", True)
    df.write.mode(mode).options(**options).format(fmt).save(target)
