"""Ingestion: CSV to typed, compressed and well laid out parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"

# Id breakpoints of the partitioned source tables (source, table): (column, breaks).
BREAKS = {
    ("eicu", "nursecharting"): ("patientunitstayid", [514528, 1037072, 1453997, 1775421, 2499831, 2937948, 3213286]),
    ("eicu", "vitalperiodic"): ("patientunitstayid", [514528, 1037072, 1453997, 1775421, 2499831, 2937948, 3213286]),
    ("miiv", "labevents"): ("itemid", [50868, 50902, 50943, 50983, 51146, 51248, 51256, 51279, 51491]),
    ("miiv", "poe"): ("subject_id", [12017899, 13999829, 15979442, 17994364]),
    ("miiv", "chartevents"): ("itemid", [
        220048, 220059, 220181, 220228, 220615, 223782, 223835, 223905, 223962, 223990, 224015, 224055, 224082, 224093,
        224328, 224650, 224701, 224850, 225072, 226104, 227240, 227467, 227950, 227960, 228004, 228397, 228594, 228924,
        229124,
    ]),
    ("aumc", "listitems"): ("itemid", [12290]),
    ("aumc", "numericitems"): ("itemid", [
        6641, 6642, 6643, 6664, 6666, 6667, 6669, 6672, 6673, 6675, 6707, 6709, 8874, 12270, 12275, 12278, 12281, 12286,
        12303, 12561, 12576, 12804, 14841,
    ]),
    ("hirid", "observations"): ("variableid", [
        110, 120, 200, 210, 211, 300, 620, 2010, 2610, 3110, 4000, 5685, 15001565, 30005075,
    ]),
    ("hirid", "pharma"): ("pharmaid", [431]),
}


def reject_line(raw: DataFrame) -> Column:
    """The text of a malformed line. It names every column: the reader parses and judges only columns that are used."""
    columns = [F.col(c).cast("string") for c in raw.columns if c != CORRUPT]
    return F.coalesce(F.col(CORRUPT), F.concat_ws(",", *columns)).alias(CORRUPT)


def read_raw_csv(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a CSV with a declared schema."""
    typed = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    raw = spark.read.schema(typed).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    ).csv(paths)
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT), raw.where(F.col(CORRUPT).isNotNull()).select(reject_line(raw))


def rejects_of(target: str) -> str:
    return target.rstrip("/") + "-rejects"


def import_table(
    spark: SparkSession, paths: str | list[str], target: str, schema: str, rejects: str | None = None,
    partition_by: list[str] | None = None, compression: str = "zstd", mode: str = "overwrite",
) -> DataFrame:
    """CSV to parquet; malformed lines go to the text folder ``rejects``, by default beside the target."""
    good, bad = read_raw_csv(spark, paths, schema)
    write_table(good, target, partition_by, compression, mode)
    bad.write.mode(mode).text(rejects or rejects_of(target))
    return spark.read.parquet(target)


def write_table(
    df: DataFrame, target: str, partition_by: list[str] | None = None, compression: str = "zstd", mode: str = "overwrite",
    rows_per_file: int | None = None,
) -> None:
    writer = df.write.mode(mode).option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)


def partition_number(value: str | Column, breaks: list[int]) -> Column:
    """1 below the first break, one more from each break on."""
    v = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, b: a + b, [(v >= b).cast("int") for b in breaks], F.lit(1))


def write_id_partitions(df: DataFrame, target: str, column: str, breaks: list[int], part: str = "part") -> None:
    """Partition folders by id ranges; large parts are split over tasks, small ones joined."""
    numbered = df.withColumn(part, partition_number(column, breaks))
    write_table(numbered.hint("rebalance", part), target, [part])


def write_row_shards(df: DataFrame, target: str, rows: int) -> None:
    write_table(df, target, rows_per_file=rows)


def write_for_filtering(df: DataFrame, target: str, columns: list[str], partition_by: list[str] | None = None) -> None:
    """Range-sorted by the filter columns, so row groups can be skipped."""
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    write_table(ranged, target, partition_by)


_RANK = ["void", "boolean", "int", "bigint", "double", "string"]


def _wider(a: str, b: str) -> str:
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    numeric = {"int", "bigint", "double"}
    if a in numeric and b in numeric:
        return max(a, b, key=_RANK.index)
    return "string"


def widened_schema(frames: list[DataFrame]) -> dict[str, str]:
    """One type per column that holds the values of all frames."""
    out: dict[str, str] = {}
    for df in frames:
        for f in df.schema:
            kind = f.dataType.simpleString()
            out[f.name] = _wider(out.get(f.name, "void"), {"float": "double"}.get(kind, kind))
    return {c: "string" if kind == "void" else kind for c, kind in out.items()}


def union_widened(frames: list[DataFrame]) -> DataFrame:
    """Rows of part files whose column types disagree."""
    kinds = widened_schema(frames)
    cast = [df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def mixed_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})
