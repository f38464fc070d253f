"""Session settings the operators are designed for, and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and sizes shuffles from
# observed bytes; the operators never rely on a fixed partition count.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the warehouse where that is not set: both are shared on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    This cuts the lineage, survives lost executors and, unlike a raw checkpoint,
    keeps column pruning and real sizes for the steps that follow.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.parquet(target)
