"""Snapshot documents: one JSON per case, with telemetry nested or at the root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import clock, spans as S

REFERENCES = "array<struct<refType:string,traceID:string,spanID:string>>"
SPAN = (
    f"struct<traceID:string,spanID:string,operationName:string,references:{REFERENCES},startTime:bigint,duration:bigint,"
    f"tags:{S.TAGS},logs:{S.SPAN_LOGS},processID:string>"
)
METRICS = "array<struct<metric_name:string,query:string,data:array<struct<timestamp:double,value:double>>>>"
TRACE = f"struct<traceID:string,spans:array<{SPAN}>,processes:map<string,struct<serviceName:string>>>"
TRACES = f"array<{TRACE}>"
TELEMETRY = f"struct<logs:map<string,array<string>>,metrics:{METRICS},traces:{TRACES}>"
SNAPSHOT = (
    f"run_id string, inject_time double, ground_truth_service string, ground_truth_fault_type string, "
    f"metadata struct<scenario:string,status:string>, telemetry {TELEMETRY}, baseline {TELEMETRY}, "
    f"logs map<string,array<string>>, metrics {METRICS}, traces {TRACES}"
)


def read_snapshots(spark: SparkSession, glob: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Cases, logs, points and spans of all snapshots; a document may nest its telemetry or not.

    A file is one document, or one document per line with `multi_line=False`.
    """
    docs = spark.read.schema(SNAPSHOT).option("multiLine", str(multi_line).lower()).json(glob)
    docs = docs.withColumn("run_id", F.coalesce("run_id", F.lit("unknown")))
    sides = []
    for phase, source in (("incident", "telemetry"), ("baseline", "baseline")):
        part = {n: F.col(f"{source}.{n}") for n in ("logs", "metrics", "traces")}
        if phase == "incident":
            part = {n: F.coalesce(c, F.col(n)) for n, c in part.items()}
        sides.append(
            docs.select(F.col("run_id").alias("case_id"), F.lit(phase).alias("phase"), *[c.alias(n) for n, c in part.items()])
        )
    both = sides[0].unionByName(sides[1])
    cases = docs.select(
        F.col("run_id").alias("case_id"), "inject_time", F.col("ground_truth_service").alias("gt_service"),
        F.col("ground_truth_fault_type").alias("gt_fault"), F.col("metadata.scenario").alias("scenario"),
    )
    logs = (
        both.select("case_id", "phase", F.explode("logs").alias("service", "lines"))
        .select("case_id", "phase", "service", F.posexplode("lines").alias("line_no", "line"))
        .select(
            "case_id", "phase", "service", F.col("line_no").cast("bigint").alias("line_no"),
            clock.line_ts(F.col("line")).alias("ts"), "line",
        )
    )
    points = (
        both.select("case_id", "phase", F.explode("metrics").alias("m"))
        .select("case_id", "phase", "m.metric_name", "m.query", F.posexplode("m.data").alias("seq", "p"))
        .select(
            "case_id", "phase", "metric_name", "query", clock.epoch_seconds(F.col("p.timestamp")).alias("ts"),
            F.coalesce("p.value", F.lit(0.0)).alias("value"), F.col("seq").cast("bigint").alias("seq"),
        )
    )
    spans = both.select("case_id", "phase", F.explode("traces").alias("t")).select("case_id", "phase", "t.*")
    return {"cases": cases, "logs": logs, "points": points, "spans": explode_traces(spans)}


def explode_traces(traces: DataFrame) -> DataFrame:
    """Trace documents (…, traceID, spans, processes) → span rows; a process names spans that carry no service."""
    keep = [c for c in traces.columns if c not in ("traceID", "spans", "processes")]
    rows = traces.select(*keep, "processes", F.posexplode("spans").alias("seq", "s"))
    tags = F.coalesce("s.tags", F.array().cast(S.TAGS))
    of_process = F.try_element_at("processes", F.col("s.processID"))["serviceName"]
    named = S.span_service(tags)
    service = F.when(named == "unknown_service", F.coalesce(of_process, named)).otherwise(named)
    return rows.select(
        *keep,
        F.col("s.traceID").alias("trace_id"),
        F.col("s.spanID").alias("span_id"),
        S.parent_of(F.col("s.references")).alias("parent_id"),
        service.alias("service"),
        F.col("s.operationName").alias("operation"),
        F.col("s.startTime").alias("start_us"),
        F.col("s.duration").alias("duration_us"),
        tags.alias("tags"),
        F.coalesce("s.logs", F.array().cast(S.SPAN_LOGS)).alias("logs"),
        F.col("seq").cast("bigint").alias("seq"),
    )
