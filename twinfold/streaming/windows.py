"""Windowed counts and idempotent intake; each works on a batch and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_limit(requests: DataFrame, by: str, at: str, length: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """(by, window_start, requests): tumbling windows with more than ``limit`` requests."""
    rows = requests.withWatermark(at, late) if requests.isStreaming else requests
    counted = rows.groupBy(F.window(at, length).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > limit).select(by, F.col("w.start").alias("window_start"), "requests")


def first_of(rows: DataFrame, keys: list[str], order: str, at: str | None = None, late: str = "2 days") -> DataFrame:
    """The first row of every key: by ``order`` on a batch, as it arrives (within ``late``) on a stream."""
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def latest_state(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One row a key: its last event, by time and then by ``tie``; the state table of an event log."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(key, "r.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once into a parquet table."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
