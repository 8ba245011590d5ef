"""Streaming span de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_dedup(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Pass each span on once; repeats are recognised as long as the watermark keeps its id."""
    return (
        spans.withColumn("started_at", F.timestamp_micros("start_us"))
        .withWatermark("started_at", delay)
        .dropDuplicatesWithinWatermark(["case_id", "trace_id", "span_id"])
        .drop("started_at")
    )
