"""What the operators share: the folder for written tables, text columns, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches near ``BATCH_BYTES``, by rows alone a batch of long texts would be as large as they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is not set.

    Both are folders that the driver and all executors reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps do not run it again, and a lost
    executor costs no lineage."""
    target = folder or work_folder(df.sparkSession)
    bound_batches(df.sparkSession)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def text_bytes(name: str = "text") -> Column:
    """The text's UTF-8 bytes, none for null: Python then needs no decoding."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def document_columns(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and the text as bytes, whatever else the table has."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def remainder(modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def highest(df: DataFrame, bucket: Column, most: int) -> DataFrame:
    """The rows of the highest buckets that have at most ``most`` rows together, whole buckets only.

    ``bucket`` is an integer expression with some ten thousand values at most: the driver gets their counts. Unlike an ordered
    limit, no task and no driver ever holds ``most`` rows from every partition.
    """
    counts = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("n")).where("__bucket IS NOT NULL").collect()
    cut, total = None, 0
    for r in sorted(counts, key=lambda r: -r["__bucket"]):
        total += r["n"]
        if total > most:
            break
        cut = r["__bucket"]
    return df.where(F.lit(False)) if cut is None else df.where(bucket >= cut)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the ``text`` bytes of each stay near ``most``; one long text is a batch of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        bins = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls in one array, and where each value begins and ends."""
    wide = column.type in (pa.large_binary(), pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
