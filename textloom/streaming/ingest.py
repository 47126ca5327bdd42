"""Incremental ingest: Structured Streaming with ``availableNow`` and idempotent batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.shared import create_if_absent


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def claim(spark: SparkSession, target: str, checkpoint: str) -> None:
    """Name the checkpoint's query as the owner of a target, or fail if another one is: its batches would be overwritten."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
    if not create_if_absent(spark, f"{target}/_owner/id", own) and spark.read.text(f"{target}/_owner/id").first()[0] != own:
        raise ValueError(f"{target} is filled by another checkpoint")


def ingest(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], sink: Callable[[DataFrame], None] | None = None, at: str | None = None, horizon: str = "7 days"
) -> StreamingQuery:
    """Append rows whose key is not stored yet; a batch that is run again adds nothing.

    Each batch goes to a folder of its own number, overwritten on a retry, and is
    compared only with earlier batches: with all of them, so that its cost grows with
    what is stored, or, where ``at`` names a time, with stored rows from ``horizon`` before the batch's
    first time on, which Parquet's statistics find. A key that comes again later than that is new.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates(keys)
        if number == 0:
            claim(spark, target, checkpoint)
        if number:
            earlier = spark.read.parquet(target).where(F.col("batch") < number)
            if at is not None:
                since = df.agg((F.min(at) - F.expr(f"INTERVAL {horizon}")).alias("t")).first()["t"]
                earlier = earlier.where(F.col(at).isNull() | (F.col(at) >= F.lit(since)))
            new = new.join(earlier.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if sink is not None:
            sink(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, keys: list[str], value: str, name: str, checkpoint: str) -> StreamingQuery:
    """Stateful accumulation: counts and sums by key in complete mode."""
    sums = stream.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling counts with a watermark, for event-time sources."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
