"""Streaming time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import constants as K


def stream_buckets(
    signals: DataFrame,
    cases: DataFrame,
    size: float = K.BUCKET_SECONDS,
    delay: str = "30 seconds",
    baseline_seconds: float = K.BASELINE_SECONDS,
    incident_seconds: float = K.INCIDENT_SECONDS,
) -> DataFrame:
    """Counts per case and bucket over a stream of signals(case_id, ts, service, kind).

    Buckets are laid out from the injection as in the batch form. The end of a bucket is its event time:
    a bucket is final, and later rows for it are dropped, once the watermark has passed that end. In append mode it
    is written then, once. Rows of kind "clock" count for nothing and lie in no window; they say how late it is, so
    that the last buckets become final, too.
    """
    clock = F.col("kind") == "clock"
    index = F.floor((F.col("ts") - F.col("inject_time")) / F.lit(size))
    end = F.timestamp_micros(((F.col("inject_time") + (F.col("bucket_index") + 1) * F.lit(size)) * 1e6).cast("bigint"))
    known = (F.col("service") != K.UNKNOWN_SERVICE) & (F.col("service") != "") & ~clock
    return (
        signals.join(cases.select("case_id", "inject_time"), "case_id")
        .filter(clock | F.col("ts").between(F.col("inject_time") - baseline_seconds, F.col("inject_time") + incident_seconds))
        .withColumn("bucket_index", index)
        .withColumn("bucket_end", end)
        .withWatermark("bucket_end", delay)
        .groupBy("case_id", "bucket_index", "bucket_end")
        .agg(
            F.count_if(F.col("kind") == "log").alias("log_count"),
            F.count_if(F.col("kind") == "metric").alias("metric_points_count"),
            F.count_if(F.col("kind") == "span").alias("span_count"),
            F.collect_set(F.when(known, F.col("service"))).alias("services"),
        )
        .filter("log_count + metric_points_count + span_count > 0")
        .withColumn("services", F.sort_array("services"))
    )
