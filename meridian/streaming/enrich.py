"""Structured Streaming: probes are geocoded as they come, samples summed in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.geocode import ReverseGeocoder


def enrich(stream: DataFrame, geocoder: ReverseGeocoder, keys: list[str], sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Answers each micro-batch of (keys, lat, lon) and gives it to all sinks.

    The batch is computed once however many sinks there are; a sink gets the batch's
    number and must ignore one that it has seen, for results exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        answered = geocoder.find_many(batch, keys).persist()
        try:
            for sink in sinks:
                sink(answered, number)
        finally:
            answered.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def timed(rows: DataFrame) -> DataFrame:
    """Watermarks need an instant; timestamps without a zone are the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_summary(samples: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Peaks and means of runtime samples in tumbling windows of event time."""
    return timed(samples).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.max("heap_alloc").alias("peak_heap_alloc"), F.max("cpu_percent").alias("peak_cpu"), F.avg("cpu_percent").alias("avg_cpu")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "peak_heap_alloc", "peak_cpu", "avg_cpu")


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
