"""Structured Streaming forms of the time reductions (an extension: bounded inputs need none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import timeunits as tu
from lodegrid.operators.reduce import aggregate


def _interval(step: str) -> str:
    return f"{tu.micros(tu.step(step))} microseconds"


def resample_stream(events: DataFrame, time: str, step: str, fn: str, keys: list[str], value: str, late: str = "1,h") -> DataFrame:
    """Tumbling buckets over a stream, closed once the watermark has passed them by ``late``."""
    f = aggregate(fn)
    window = F.window(time, _interval(step))
    grouped = events.withWatermark(time, _interval(late)).groupBy(window.alias("__w"), *keys)
    return grouped.agg(f(F.col(value)).alias("value")).select(*keys, F.col("__w.start").alias("time"), "value")


def sliding_stream(events: DataFrame, time: str, width: str, slide: str, fn: str, keys: list[str], value: str, late: str = "1,h") -> DataFrame:
    """Sliding windows over a stream."""
    f = aggregate(fn)
    window = F.window(time, _interval(width), _interval(slide))
    grouped = events.withWatermark(time, _interval(late)).groupBy(window.alias("__w"), *keys)
    return grouped.agg(f(F.col(value)).alias("value")).select(*keys, F.col("__w.start").alias("time"), "value")


def append_chunks(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str]):
    """A stream into a partitioned Parquet store; files become visible once, whatever is retried."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).outputMode("append").trigger(availableNow=True).start()
