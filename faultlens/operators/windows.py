"""Phases, time buckets, sampling, case discovery and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import clock, naming
from faultlens.plans.ordering import numbered
from faultlens.sources.bounds import Bounds


def phase_of(ts: Column, inject: Column, baseline_seconds: float, incident_seconds: float) -> Column:
    return F.when((ts >= inject - baseline_seconds) & (ts < inject), F.lit("baseline")).when(
        (ts >= inject) & (ts <= inject + incident_seconds), F.lit("incident")
    )


def label_phase(
    df: DataFrame,
    cases: DataFrame,
    baseline_seconds: float = K.BASELINE_SECONDS,
    incident_seconds: float = K.INCIDENT_SECONDS,
    within: Bounds | None = None,
) -> DataFrame:
    """Keep rows inside the case's window and say on which side of the injection they lie.

    `within`, the bounds of these cases and windows, stands before the join as literals. They reach the scan where
    `ts` is a stored column and `case_id` a column or a folder.
    """
    if within is not None:
        df = df.filter(within.of_cases(F.col("case_id")) & within.of_instants(F.col("ts")))
    return (
        df.join(cases.select("case_id", "inject_time"), "case_id")
        .withColumn("phase", phase_of(F.col("ts"), F.col("inject_time"), baseline_seconds, incident_seconds))
        .filter(F.col("phase").isNotNull())
        .drop("inject_time")
    )


def label_trace_phase(
    spans: DataFrame,
    cases: DataFrame,
    baseline_seconds: float = K.BASELINE_SECONDS,
    incident_seconds: float = K.INCIDENT_SECONDS,
) -> DataFrame:
    """A whole trace takes the phase of its earliest span; adds `trace_start_us`."""
    starts = spans.groupBy("case_id", "trace_id").agg(F.min("start_us").alias("trace_start_us"))
    labelled = (
        starts.withColumn("ts", F.col("trace_start_us") / 1e6)
        .transform(label_phase, cases, baseline_seconds, incident_seconds)
        .drop("ts")
    )
    return spans.join(labelled, ["case_id", "trace_id"])


def as_lines(logs: DataFrame) -> DataFrame:
    """Add the line form `[instant] message`."""
    return logs.select(
        "case_id", "phase", "service", "ts", "message", "seq",
        clock.format_line(F.col("ts"), F.col("message")).alias("line"),
    )


def number_lines(logs: DataFrame) -> DataFrame:
    """Line form and 0-based line number per (case, phase, service), in time order.

    Messages are written once, with what their numbers need; the line form is made when they are read back.
    """
    rows = logs.select("case_id", "phase", "service", "ts", "message", "seq")
    found = numbered(rows, ["case_id", "phase", "service"], ["ts", "seq"], F.floor(F.col("ts") * 10), "line_no")
    return found.withColumn("line", clock.format_line(F.col("ts"), F.col("message")))


def time_buckets(
    logs: DataFrame,
    points: DataFrame,
    spans: DataFrame,
    cases: DataFrame,
    size: float = K.BUCKET_SECONDS,
    baseline_seconds: float = K.BASELINE_SECONDS,
    incident_seconds: float = K.INCIDENT_SECONDS,
) -> DataFrame:
    """Counts per signal and the services seen, per bucket relative to the injection."""
    signals = (
        logs.select("case_id", "ts", "service", F.lit("log").alias("kind"))
        .unionByName(
            points.select("case_id", "ts", naming.bucket_service(F.col("metric_name")).alias("service"), F.lit("metric").alias("kind"))
        )
        .unionByName(
            spans.select("case_id", (F.col("start_us") / 1e6).alias("ts"), "service", F.lit("span").alias("kind"))
        )
    )
    index = F.floor((F.col("ts") - F.col("inject_time")) / F.lit(size))
    start = F.col("inject_time") + F.col("bucket_index") * F.lit(size)
    known = (F.col("service") != K.UNKNOWN_SERVICE) & (F.col("service") != "")
    return (
        signals.join(cases.select("case_id", "inject_time"), "case_id")
        .filter(
            (F.col("ts") >= F.col("inject_time") - baseline_seconds)
            & (F.col("ts") <= F.col("inject_time") + incident_seconds)
        )
        .groupBy("case_id", "inject_time", index.alias("bucket_index"))
        .agg(
            F.count_if(F.col("kind") == "log").alias("log_count"),
            F.count_if(F.col("kind") == "metric").alias("metric_points_count"),
            F.count_if(F.col("kind") == "span").alias("span_count"),
            F.sort_array(F.collect_set(F.when(known, F.col("service")))).alias("services"),
        )
        .select(
            "case_id", "bucket_index", start.alias("start_ts"), (start + size).alias("end_ts"),
            "log_count", "metric_points_count", "span_count", "services",
        )
    )


def _pick_order(*parts: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def sample_traces(
    spans: DataFrame,
    incident_traces: int = K.SAMPLE_INCIDENT_TRACES,
    baseline_traces: int = K.SAMPLE_BASELINE_TRACES,
    seed: int = K.SAMPLE_SEED,
) -> DataFrame:
    """Whole-trace sample of every case, by hash order within each side.

    A trace is drawn for the side(s) its own rows lie on, as a row-wise mask would see it. Which cases to sample is
    the caller's choice: hand in their spans.
    """
    ids = spans.select("case_id", "phase", "trace_id").distinct()
    by_hash = Window.partitionBy("case_id", "phase").orderBy(
        _pick_order("case_id", "trace_id", seed=seed), "trace_id"
    )
    most = max(incident_traces, baseline_traces)
    quota = F.when(F.col("phase") == "incident", incident_traces).otherwise(baseline_traces)
    picked = (
        ids.withColumn("pick", F.row_number().over(by_hash))
        .filter(F.col("pick") <= most)
        .filter(F.col("pick") <= quota)
        .select("case_id", "trace_id")
        .distinct()
    )
    return spans.join(picked, ["case_id", "trace_id"], "left_semi").select(*spans.columns)


def sample_rows(
    spans: DataFrame,
    rows: int = K.SAMPLE_TRIGGER_ROWS,
    incident_rows: int = K.SAMPLE_INCIDENT_ROWS,
    seed: int = K.SAMPLE_SEED,
) -> DataFrame:
    """Sample of `rows` rows a case, for spans without trace ids: incident rows first, filled up with baseline rows.

    Rows are ranked by a hash; the rank comes from hash ranges, so a large case spans many tasks.
    """
    sizes = spans.groupBy("case_id").agg(
        F.count_if(F.col("phase") == "incident").alias("__inc")
    )
    kept_incident = F.least(F.col("__inc"), F.lit(incident_rows))
    quota = F.when(F.col("phase") == "incident", kept_incident).otherwise(F.lit(rows) - kept_incident)
    hashed = spans.withColumn("__h", _pick_order("case_id", "span_id", seed=seed))
    ranked = numbered(
        hashed, ["case_id", "phase"], ["__h", "span_id"], F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"), "__pick"
    )
    return (
        ranked.join(sizes, "case_id")
        .filter(F.col("__pick") < quota)
        .select(*spans.columns)
    )


def discover_cases(
    cases: DataFrame,
    files: DataFrame,
    suites: list[str] | None = None,
    faults: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Cases with logs, traces and all four files; optional filters ignore case."""
    out = cases.filter(F.col("has_logs") & F.col("has_traces"))
    if suites:
        out = out.filter(F.upper("dataset").isin(*[s.upper() for s in suites]))
    if faults:
        out = out.filter(F.lower("gt_fault").isin(*[f.lower() for f in faults]))
    complete = (
        files.filter(F.col("file_name").isin(*K.CASE_FILES))
        .groupBy("case_id")
        .agg(F.count_distinct("file_name").alias("n"))
        .filter(F.col("n") == len(K.CASE_FILES))
    )
    out = out.join(complete, "case_id", "left_semi")
    return out if limit is None else out.orderBy("case_id").limit(max(0, limit))


def with_mode(df: DataFrame, modes=K.MODES) -> DataFrame:
    """Every row once per mode."""
    return df.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def pending(cases: DataFrame, modes, scores: DataFrame, artifacts: DataFrame, backfill: bool = False) -> DataFrame:
    """(case, mode) pairs still to run; with backfill also those scored but without an artifact.

    `keep_score` tells that an existing score row stays as it is.
    """
    scored = scores.select("case_id", "mode").distinct().withColumn("keep_score", F.lit(True))
    pairs = with_mode(cases.select("case_id"), modes).join(scored, ["case_id", "mode"], "left")
    pairs = pairs.withColumn("keep_score", F.coalesce("keep_score", F.lit(False)))
    if not backfill:
        return pairs.filter(~F.col("keep_score"))
    have = artifacts.select("case_id", "mode").distinct().withColumn("has_artifact", F.lit(True))
    return (
        pairs.join(have, ["case_id", "mode"], "left")
        .filter(~F.col("keep_score") | F.col("has_artifact").isNull())
        .drop("has_artifact")
    )
