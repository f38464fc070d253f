"""Converting an arriving folder of CSV files, each file once and resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from staygrid.sources.buckets import BUCKET, Layout, bucket_of
from staygrid.sources.convert import CORRUPT, reject_line, rejects_of


def csv_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1_000, sep: str = ",") -> DataFrame:
    """New CSV files of a folder; a malformed line has its text in the corrupt-record column."""
    typed = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    return (
        spark.readStream.schema(typed).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )


def ingest(
    rows: DataFrame, target: str, checkpoint: str, layout: Layout | None = None, rejects: str | None = None
) -> list[StreamingQuery]:
    """Append what is new to parquet and stop; a restart continues where it ended.

    ``checkpoint`` must be a shared folder. With a layout rows go to their bucket.
    Malformed lines of ``csv_stream`` are appended as text to ``rejects``, by
    default beside the target, by a second query with a state of its own.
    """
    started = []
    if CORRUPT in rows.columns:
        bad = rows.where(F.col(CORRUPT).isNotNull()).select(reject_line(rows))
        writer = bad.writeStream.format("text").option("checkpointLocation", rejects_of(checkpoint))
        started.append(writer.trigger(availableNow=True).start(rejects or rejects_of(target)))
        rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if layout is not None:
        rows = rows.withColumn(BUCKET, bucket_of(rows[layout.column], layout.buckets))
    writer = rows.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", checkpoint)
    if layout is not None:
        writer = writer.partitionBy(BUCKET)
    return [writer.trigger(availableNow=True).start(target), *started]
