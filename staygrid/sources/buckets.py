"""Hash-bucketed layout of item-long tables, so reads touch only the items' buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKET = "bucket_id"
BUCKETS = 100

# Bucket column per source table.
PRESETS = {
    ("aumc", "numericitems"): "itemid",
    ("aumc", "listitems"): "itemid",
    ("hirid", "observations"): "variableid",
    ("hirid", "pharma"): "pharmaid",
    ("miiv", "chartevents"): "itemid",
    ("miiv", "labevents"): "itemid",
    ("miiv", "inputevents"): "itemid",
    ("eicu", "nursecharting"): "nursingchartcelltypevalname",
    ("eicu", "lab"): "labname",
    ("mimic3", "chartevents"): "itemid",
    ("mimic3", "labevents"): "itemid",
    ("sic", "data_float_h"): "DataID",
    ("sic", "laboratory"): "LaboratoryID",
    ("sic", "medication"): "DrugID",
}


@dataclass(frozen=True)
class Layout:
    column: str
    buckets: int = BUCKETS
    compression: str = "zstd"


def preset(source: str, table: str, buckets: int = BUCKETS) -> Layout:
    return Layout(PRESETS[(source, table)], buckets)


def bucket_of(item: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, target: str, layout: Layout, mode: str = "overwrite") -> None:
    """Partition folders by item bucket.

    Rebalancing splits a bucket that holds much of the table over several tasks
    and files; inside each file rows are sorted by item.
    """
    placed = df.withColumn(BUCKET, bucket_of(F.col(layout.column), layout.buckets))
    placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, layout.column).write.mode(mode).option(
        "compression", layout.compression
    ).partitionBy(BUCKET).parquet(target)


def read_buckets(
    spark: SparkSession, path: str, layout: Layout, items: list, columns: list[str] | None = None
) -> DataFrame:
    """Rows of the wanted items; only their bucket folders are listed and read."""
    df = spark.read.parquet(path)
    kind = df.schema[layout.column].dataType
    wanted = [F.lit(i).cast(kind) for i in items]
    places = [bucket_of(i, layout.buckets) for i in wanted]
    rows = df.where(F.col(BUCKET).isin(*places) & F.col(layout.column).isin(*wanted)).drop(BUCKET)
    return rows.select(*columns) if columns else rows


def save_bucketed_table(df: DataFrame, name: str, layout: Layout, mode: str = "overwrite") -> None:
    """The same as a catalogue table, whose buckets joins and filters use on their own."""
    df.write.mode(mode).bucketBy(layout.buckets, layout.column).sortBy(layout.column).saveAsTable(name)
