"""Streaming operators, run over files written from the tables until all of them are processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import naming
from faultlens.plans import views
from faultlens.plans.materialize import materialize, scratch_path
from faultlens.streaming.buckets import stream_buckets as buckets
from faultlens.streaming.dedup import stream_dedup as dedup
from faultlens.streaming.runs import drain, latest, stream_cases as run_stream
from queries.common import investigation, rounded
from queries.windows import SQL as WINDOW_SQL

QUERIES, SQL = {}, {}


#: Rows of a landed file.
FILE_ROWS = 1_000_000


def _landed(spark, df, label, files=4):
    """Write a DataFrame as several files, `files` at least and more where they would grow large, and open it as a stream of two batches."""
    path = scratch_path(spark, label)
    df = materialize(df, f"{label}-rows")
    files = max(files, -(-df.count() // FILE_ROWS))
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


def _signals(inv):
    return (
        inv.raw_logs.select("case_id", "ts", "service", F.lit("log").alias("kind"))
        .unionByName(inv.raw_points.select("case_id", "ts", naming.bucket_service(F.col("metric_name")).alias("service"), F.lit("metric").alias("kind")))
        .unionByName(inv.raw_spans.select("case_id", (F.col("start_us") / 1e6).alias("ts"), "service", F.lit("span").alias("kind")))
    )


def stream_buckets(spark, sf):
    inv = investigation(spark, sf)
    signals = _signals(inv)
    # Files hold rows of all times, so nothing may count as late here: the delay spans the window.
    counted = buckets(
        _landed(spark, signals, "signals"), inv.cases, K.BUCKET_SECONDS, "1 hour", views.BASELINE_SECONDS, views.INCIDENT_SECONDS
    )
    out = scratch_path(spark, "buckets")
    drain(counted, out, scratch_path(spark, "checkpoint"), "update")
    start = F.round(F.unix_micros("bucket_end") / 1e6 - K.BUCKET_SECONDS, 3)
    return latest(spark, out, ["case_id", "bucket_index"]).select(
        "case_id", "bucket_index", start.alias("start_ts"), F.round(start + K.BUCKET_SECONDS, 3).alias("end_ts"),
        "log_count", "metric_points_count", "span_count", F.array_join("services", ",").alias("services"),
    )


#: Seconds around the injection at which telemetry lands, and what comes too late: rows of the first part that land last.
LANDINGS = (-views.BASELINE_SECONDS, -300.0, 300.0, views.INCIDENT_SECONDS + 1)
LATE_SERVICES = ("svc1", "svc7")


def stream_buckets_late(spark, sf):
    """Telemetry lands in the order of time and is counted in append mode after each landing; some of it is late."""
    inv = investigation(spark, sf)
    since = F.col("ts") - views.INJECT_SECONDS
    late = (since < LANDINGS[1]) & F.col("service").isin(*LATE_SERVICES)
    path, out, checkpoint = (scratch_path(spark, x) for x in ("signals", "buckets", "checkpoint"))
    # Written once: every landing would derive the whole telemetry again for its part of it.
    signals = materialize(_signals(inv), "all-signals")
    parts = [signals.filter(~late & (since >= a) & (since < b)) for a, b in zip(LANDINGS, LANDINGS[1:])]
    clock = inv.cases.select("case_id", (F.col("inject_time") + 1e6).alias("ts"), F.lit("").alias("service"), F.lit("clock").alias("kind"))
    for k, part in enumerate([*parts, signals.filter(late).unionByName(clock)]):
        part.write.parquet(f"{path}/landing={k}")
        stream = spark.readStream.schema(signals.schema).parquet(f"{path}/*")
        counted = buckets(stream, inv.cases, K.BUCKET_SECONDS, "30 seconds", views.BASELINE_SECONDS, views.INCIDENT_SECONDS)
        drain(counted, out, checkpoint)
    return spark.read.parquet(out).select(
        "case_id", "bucket_index", "log_count", "metric_points_count", "span_count", F.array_join("services", ",").alias("services")
    )


def stream_cases(spark, sf):
    inv = investigation(spark, sf)
    # The telemetry has landed as files; two files of case rows say which cases are complete.
    root, out = scratch_path(spark, "landed"), scratch_path(spark, "scored")
    telemetry = []
    for df, name in ((inv.raw_logs, "logs"), (inv.raw_points, "points"), (inv.raw_spans, "spans")):
        df.write.partitionBy("case_id").parquet(f"{root}/{name}")
        telemetry.append(spark.read.schema(df.schema).parquet(f"{root}/{name}"))
    run_stream(
        _landed(spark, inv.cases, "cases", 2), *telemetry, out, scratch_path(spark, "checkpoint"),
        baseline_seconds=views.BASELINE_SECONDS, incident_seconds=views.INCIDENT_SECONDS,
    )
    return latest(spark, out, ["case_id", "mode"]).select(
        "case_id", "mode", "predicted_service", "top1_hit", "error_bucket", *rounded("mrr")
    )


def stream_dedup(spark, sf):
    spans = investigation(spark, sf).raw_spans.select("case_id", "trace_id", "span_id", "start_us", "duration_us")
    twice = spans.unionByName(spans.filter("duration_us > 100000"))
    out = scratch_path(spark, "deduped")
    drain(dedup(_landed(spark, twice, "captured"), "1 hour"), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("case_id", "trace_id", "span_id", "duration_us")


QUERIES.update(stream_buckets=stream_buckets, stream_buckets_late=stream_buckets_late, stream_cases=stream_cases, stream_dedup=stream_dedup)
SQL["stream_buckets"] = WINDOW_SQL["time_buckets"]
_LATE = ", ".join(f"'{s}'" for s in LATE_SERVICES)
SQL["stream_buckets_late"] = (
    WINDOW_SQL["time_buckets"]
    .replace(f"{views.INJECT_SECONDS}.0 - {views.BASELINE_SECONDS}", f"{views.INJECT_SECONDS}.0 - {views.BASELINE_SECONDS} AND (ts >= {views.INJECT_SECONDS}.0 + {LANDINGS[1]} OR service NOT IN ({_LATE}))")
    .replace(f"round({views.INJECT_SECONDS}.0 + b * 5, 3) AS start_ts, round({views.INJECT_SECONDS}.0 + b * 5 + 5, 3) AS end_ts,\n", "\n")
)
SQL["stream_cases"] = "SELECT case_id, mode, predicted_service, top1_hit, error_bucket, round(CAST(mrr AS DOUBLE), 4) AS mrr FROM scores"
SQL["stream_dedup"] = "SELECT case_id, trace_id, span_id, duration_us FROM v_spans"
