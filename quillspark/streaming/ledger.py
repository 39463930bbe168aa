"""Append-only ledgers over file streams: every run id once, resumed from the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, folder: str, schema: str, key: str = "run_id") -> DataFrame:
    """Rows of JSON files as they arrive, the first of each key."""
    return spark.readStream.schema(schema).json(folder).dropDuplicates([key])


def append(rows: DataFrame, out: str, checkpoint: str, partition: str = "experiment_id") -> StreamingQuery:
    """Writes what has arrived to a Parquet ledger, and stops."""
    writer = rows.writeStream.format("parquet").partitionBy(partition).option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).outputMode("append").start()
