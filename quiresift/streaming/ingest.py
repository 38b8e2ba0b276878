"""Incremental intake as a stream over files: each file once, upserts by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiresift.scratch import shared_dir


def ingest(spark: SparkSession, source: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, pattern: str | None = None) -> StreamingQuery:
    """Start a stream over Parquet files in ``source``: all that are there now, and stop. ``sink`` gets each batch and its number.

    The checkpoint remembers files and batches, so a stopped or failed run goes
    on where it was; a sink that keys its output by the batch number writes
    each row once.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_by_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes batch n to its own folder, over what a failed try left."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def windowed_counts(events: DataFrame, time: str, by: str, value: str, size: str, late: str) -> DataFrame:
    """Counts and sums by event-time windows of ``size``, closed ``late`` after the newest event; batch or stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def windows_to_table(spark: SparkSession, source: str, pattern: str, label: str, time: str, by: str, value: str, size: str, late: str) -> DataFrame:
    """windowed_counts() of everything in ``source`` that matches, through a stream that updates windows batch by batch; each window as it was told last."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    kind = schema[time].dataType.simpleString()
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    told = windowed_counts(events, time, by, value, size, late)
    told.writeStream.outputMode("update").foreachBatch(append_by_batch(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    last = found.groupBy("start", by).agg(F.max_by(F.struct("n", "total"), "batch").alias("told"))
    return last.select(F.col("start").cast(kind).alias("start"), by, "told.*")


def run_to_table(spark: SparkSession, source: str, pattern: str, label: str) -> DataFrame:
    """Everything in ``source`` that matches, through a stream, as a table."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    query = ingest(spark, source, schema, append_by_batch(f"{base}/out"), f"{base}/checkpoint", pattern)
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
