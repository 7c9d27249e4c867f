"""Streams of files and of events: new files as rows, windows over event time, duplicates, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "csv", pattern: str = "*", max_files: int = 100, **options: str) -> DataFrame:
    """New files of a folder, with the name of the file; the stream's checkpoint knows which were read."""
    reader = spark.readStream.format(kind).schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).options(**options)
    return reader.load(folder).withColumn("file_name", F.col("_metadata.file_name"))


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, batch by batch, exactly once if ``write`` is idempotent per batch id."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], *aggregates, slide: str | None = None, late: str | None = None) -> DataFrame:  # noqa: ANN002
    """Counts over fixed or sliding windows of event time; with ``late`` as a watermark on a stream."""
    df = events.withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], *aggregates, late: str | None = None) -> DataFrame:  # noqa: ANN002
    """Runs of events less than a gap apart."""
    df = events.withWatermark(time, late) if late else events
    out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def deduplicated(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """One event per key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
