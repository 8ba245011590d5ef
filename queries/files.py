"""Sources and sinks: telemetry derived from the tables is written in file form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.plans import views
from faultlens.plans.materialize import scratch_path
from faultlens.sources.bounds import bounds_of
from faultlens.sources import captures, cases as Cs, logs as Lg, metrics as Me, results as R, snapshots as Sn, spans as Sp
from queries.common import investigation, plain_spans, rounded

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


@register(
    "SELECT case_id, CASE WHEN service = 'svc11' THEN 'unknown_service' ELSE service END AS service, round(ts, 3) AS ts, message FROM v_logs"
)
def read_logs(spark, sf):
    root = scratch_path(spark, "files")
    service = F.when(F.col("service") != "svc11", F.concat(F.lit(" "), "service", F.lit(" ")))
    raw = investigation(spark, sf).raw_logs.select(
        "case_id", (F.col("ts") * 1000).alias("Timestamp"), service.alias("Container_Name"), F.col("message").alias("Message")
    )
    # Cases with an odd number name their columns in another way and have numbers of another kind.
    odd = F.col("case_id").rlike("[13579]$")
    raw.filter(~odd).write.partitionBy("case_id").parquet(f"{root}/logs.parquet")
    other = raw.select("case_id", (F.col("Timestamp") / 1000).cast("string").alias("ts"), F.col("Container_Name").alias("pod"), F.col("Message").alias("body"))
    other.filter(odd).write.mode("append").partitionBy("case_id").parquet(f"{root}/logs.parquet")
    return Lg.read_logs(spark, root, layout="partitioned").select("case_id", "service", *rounded("ts", digits=3), "message")


@register(
    """SELECT case_id, service, round(ts, 3) AS ts, concat('"', service, '", said', chr(10), '  ', message, ' "ok"') AS message
       FROM v_logs WHERE seq % 10 <> 9"""
)
def read_logs_csv(spark, sf):
    root = scratch_path(spark, "files")
    # A tenth of the rows carries no readable instant and has to be dropped by the reader.
    stamp = (
        F.when(F.col("seq") % 10 == 9, F.lit("unknown"))
        .when(F.col("seq") % 2 == 0, F.date_format(F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise((F.col("ts") * 1000).cast("decimal(20,3)").cast("string"))
    )
    # Quotes, commas and line breaks inside of messages; cases with an odd number have other columns in another order.
    said = F.concat(F.lit('"'), "service", F.lit('", said\n  '), "message", F.lit(' "ok"'))
    raw = investigation(spark, sf).raw_logs.select("case_id", stamp.alias("time"), "service", said.alias("message"))
    odd = F.col("case_id").rlike("[13579]$")
    other = raw.select("case_id", F.col("message").alias("content"), F.lit("x,y").alias("host"), F.col("time").alias("datetime"), F.col("service").alias("app"))
    for part, mode in ((raw.filter(~odd), "error"), (other.filter(odd), "append")):
        part.write.mode(mode).partitionBy("case_id").options(header="true", quote='"', escape='"').csv(f"{root}/logs.csv")
    return Lg.read_logs(spark, root, "csv", "partitioned").select("case_id", "service", *rounded("ts", digits=3), "message")


@register("SELECT case_id, metric_name, concat('rcaeval:', metric_name) AS query, round(ts, 3) AS ts, value FROM v_points")
def read_metrics(spark, sf):
    root = scratch_path(spark, "files")
    names = [f"svc{i}_{k}" for i in range(12) for k in ("cpu", "mem", "latency", "mem_limit", "error_rate")]
    wide = investigation(spark, sf).raw_points.select(
        "case_id", F.col("ts").alias("time"), *[F.when(F.col("metric_name") == n, F.col("value")).alias(n) for n in names]
    )
    wide.write.partitionBy("case_id").parquet(f"{root}/metrics.parquet")
    return Me.read_metrics(spark, root, layout="partitioned").select("case_id", "metric_name", "query", *rounded("ts", digits=3), "value")


@register(
    f"""SELECT 'logs' AS signal, case_id, round(ts, 3) AS ts, service AS name, message AS value FROM v_logs
        WHERE ts BETWEEN {views.INJECT_SECONDS}.0 - 300 AND {views.INJECT_SECONDS}.0 + 200 AND NOT contains(case_id, 'disk')
        UNION ALL SELECT 'metrics', case_id, round(ts, 3), metric_name, printf('%.6f', value) FROM v_points
        WHERE ts BETWEEN {views.INJECT_SECONDS}.0 - 300 AND {views.INJECT_SECONDS}.0 + 200 AND NOT contains(case_id, 'disk')"""
)
def read_within_windows(spark, sf):
    # Logs with milliseconds, points with instants; the bounds of all cases but one reach both scans.
    root = scratch_path(spark, "files")
    inv = investigation(spark, sf)
    inv.raw_logs.select("case_id", F.floor(F.col("ts") * 1e6).alias("timestamp"), "service", "message").write.partitionBy("case_id").parquet(f"{root}/logs.parquet")
    names = [f"svc{i}_{k}" for i in range(12) for k in ("cpu", "mem", "latency", "mem_limit", "error_rate")]
    wide = inv.raw_points.select(
        "case_id", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint")).alias("time"), *[F.when(F.col("metric_name") == n, F.col("value")).alias(n) for n in names]
    )
    wide.write.partitionBy("case_id").parquet(f"{root}/metrics.parquet")
    within = bounds_of(inv.cases.filter("gt_fault <> 'disk'"), 300.0, 200.0)
    logs = Lg.read_logs(spark, root, layout="partitioned", within=within)
    points = Me.read_metrics(spark, root, layout="partitioned", within=within)
    return logs.select(F.lit("logs").alias("signal"), "case_id", *rounded("ts", digits=3), F.col("service").alias("name"), F.col("message").alias("value")).unionByName(
        points.select(F.lit("metrics").alias("signal"), "case_id", *rounded("ts", digits=3), F.col("metric_name").alias("name"), F.format_string("%.6f", "value").alias("value"))
    )


@register(
    """SELECT case_id, CASE (seq // 64) % 3 WHEN 0 THEN replace(metric_name, '_', '/') ELSE metric_name END AS metric_name, round(ts, 3) AS ts, value
       FROM v_points WHERE seq % 20 <> 19"""
)
def read_metrics_json(spark, sf):
    # Documents of at most 64 points in the three layouts; a twentieth of the values is no number.
    point = F.array(
        F.col("ts").cast("decimal(20,6)").cast("string"),
        F.when(F.col("seq") % 20 == 19, F.lit("bad")).otherwise(F.col("value").cast("string")),
    )
    d = investigation(spark, sf).raw_points.withColumns({"shard": F.floor(F.col("seq") / 64), "p": point})
    lists = d.groupBy("case_id", "shard", "metric_name").agg(F.collect_list("p").alias("pts"))
    svc, kind = F.split_part("metric_name", F.lit("_"), F.lit(1)), F.regexp_replace("metric_name", "^[^_]+_", "")
    kind = F.regexp_replace(kind, "_", "/")
    layout = F.col("shard") % 3
    nested = F.to_json(F.create_map(svc, F.create_map(kind, F.col("pts"))))
    flat = F.to_json(F.create_map("metric_name", F.col("pts")))
    listed = F.to_json(F.array(F.struct(F.col("metric_name").alias("metric"), F.col("pts").alias("values"))))
    docs = lists.select("case_id", F.when(layout == 0, nested).when(layout == 1, flat).otherwise(listed).alias("value"))
    root = scratch_path(spark, "files")
    docs.write.partitionBy("case_id").text(f"{root}/metrics.jsonl")
    return Me.read_metrics(spark, root, "jsonl", "partitioned").select("case_id", "metric_name", *rounded("ts", digits=3), "value")


@register(
    """SELECT case_id, metric_name, round(ts, 3) AS ts, value, row_number() OVER (PARTITION BY case_id, metric_name, seq // 4096 ORDER BY seq) - 1 AS place
       FROM v_points"""
)
def read_metrics_split(spark, sf):
    # Indented documents of at most 4096 points, each spread over tasks where it is larger than an input split.
    point = F.array(F.col("ts").cast("decimal(20,6)").cast("string"), F.col("value").cast("string"))
    d = investigation(spark, sf).raw_points.withColumn("shard", F.floor(F.col("seq") / 4096))
    lists = d.groupBy("case_id", "shard", "metric_name").agg(F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))).alias("pts"))
    labels = F.array(F.col("metric_name"), F.lit("[]}"))
    series = F.struct(labels.alias("labels"), F.col("pts.p").alias("values"), F.col("metric_name").alias("metric"))
    docs = lists.groupBy("case_id", "shard").agg(F.to_json(F.collect_list(series), {"pretty": "true"}).alias("value"))
    root = scratch_path(spark, "files")
    docs.write.partitionBy("case_id", "shard").text(f"{root}/metrics.json")
    got = Me.read_metrics(spark, root, "json-split", "partitioned")
    return got.select("case_id", "metric_name", *rounded("ts", digits=3), "value", F.col("seq").alias("place"))


SPAN_SQL = """SELECT case_id, trace_id, span_id, parent_id, service, operation, start_us, duration_us, CASE WHEN status = 504 THEN 'true' END AS error, CAST(status AS VARCHAR) AS code FROM v_spans"""


def _flat(spans):
    tag = lambda k: F.get(F.filter("tags", lambda t: t["key"] == k), F.lit(0))["value"]
    return spans.select(
        "case_id", "trace_id", "span_id", "parent_id", "service", "operation", "start_us", "duration_us",
        tag("error").alias("error"), tag("http.status_code").alias("code"),
    )


@register(SPAN_SQL)
def read_spans(spark, sf):
    root = scratch_path(spark, "files")
    raw = plain_spans(spark, sf).select(
        "case_id", F.col("start_us").alias("startTime"), F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"),
        F.coalesce("parent_id", F.lit("None")).alias("parentSpanID"), F.col("service").alias("serviceName"),
        F.col("operation").alias("operationName"), F.col("duration_us").alias("duration"), F.col("status").alias("statusCode"),
    )
    odd = F.col("case_id").rlike("[13579]$")
    raw.filter(~odd).write.partitionBy("case_id").parquet(f"{root}/traces.parquet")
    other = raw.select(
        "case_id", F.col("startTime").alias("timestamp"), F.col("traceID").alias("trace_id"), F.col("spanID").alias("span_id"), F.col("parentSpanID").alias("parent_id"),
        F.col("serviceName").alias("service_name"), F.col("operationName").alias("rpc"), F.col("duration").alias("duration_us"), F.col("statusCode").alias("status_code"),
    )
    other.filter(odd).write.mode("append").partitionBy("case_id").parquet(f"{root}/traces.parquet")
    return _flat(Sp.read_spans(spark, root, layout="partitioned"))


@register(SPAN_SQL)
def read_spans_csv(spark, sf):
    root = scratch_path(spark, "files")
    raw = plain_spans(spark, sf).select(
        "case_id", F.col("start_us").alias("time"), "trace_id", "span_id", F.coalesce("parent_id", F.lit("none")).alias("parent_id"),
        "service", "operation", (F.col("duration_us") / 1000).alias("duration_ms"), F.col("status").alias("status"),
    )
    odd = F.col("case_id").rlike("[13579]$")
    other = raw.select(
        "case_id", "status", F.col("operation").alias("method"), "service", F.col("parent_id").alias("parentId"), F.col("span_id").alias("spanId"),
        F.col("duration_ms").alias("duration_ms"), F.col("trace_id").alias("traceId"), F.col("time").alias("start_time"),
    )
    for part, mode in ((raw.filter(~odd), "error"), (other.filter(odd), "append")):
        part.write.mode(mode).partitionBy("case_id").option("header", "true").csv(f"{root}/traces.csv")
    return _flat(Sp.read_spans(spark, root, "csv", "partitioned"))


@register("SELECT case_id, inject_time FROM v_cases")
def read_inject_times(spark, sf):
    root = scratch_path(spark, "files")
    raw = investigation(spark, sf).cases.select("case_id", F.concat(F.lit(" "), (F.col("inject_time") * 1000).cast("bigint").cast("string")).alias("value"))
    raw.write.partitionBy("case_id").text(f"{root}/inject_time.txt")
    return Cs.read_inject_times(spark, root, "partitioned")


@register("SELECT case_id, dataset, gt_service, gt_fault, has_logs, has_traces FROM v_cases")
def read_registry(spark, sf):
    root = scratch_path(spark, "files")
    raw = investigation(spark, sf).cases.select(
        F.col("case_id").alias("case"), "dataset", F.col("gt_service").alias("root_cause_service"), F.col("gt_fault").alias("fault"), "has_logs", "has_traces"
    )
    raw.write.option("header", "true").csv(f"{root}/cases.csv")
    return Cs.read_registry(spark, f"{root}/cases.csv").drop("benchmark")


@register(
    """SELECT case_id, 'incident' AS phase, service, row_number() OVER (PARTITION BY case_id, service, seq // 64 ORDER BY seq) - 1 AS line_no, line FROM lines"""
)
def read_snapshots(spark, sf):
    root = scratch_path(spark, "files")
    lines = investigation(spark, sf).lines.withColumn("shard", F.floor(F.col("seq") / 64))
    docs = lines.groupBy("case_id", "service", "shard").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    logs = F.create_map("service", F.transform("l", lambda x: x["line"]))
    flat = docs.filter("shard % 2 = 0").select(F.col("case_id").alias("run_id"), logs.alias("logs"))
    nested = docs.filter("shard % 2 = 1").select(F.col("case_id").alias("run_id"), F.struct(logs.alias("logs")).alias("telemetry"))
    flat.write.json(f"{root}/flat")
    nested.write.json(f"{root}/nested")
    return Sn.read_snapshots(spark, f"{root}/*", multi_line=False)["logs"].select("case_id", "phase", "service", "line_no", "line")


@register(
    "SELECT case_id, concat(split_part(metric_name, '_', 1), '/', regexp_replace(metric_name, '^[^_]+_', '')) AS metric_name, round(ts, 3) AS ts, value FROM v_points"
)
def read_promql_matrix(spark, sf):
    root = scratch_path(spark, "files")
    d = investigation(spark, sf).raw_points.withColumn("shard", F.floor(F.col("seq") / 64))
    point = F.array(F.col("ts").cast("decimal(20,6)").cast("string"), F.col("value").cast("string"))
    lists = d.groupBy("case_id", "shard", "metric_name").agg(F.collect_list(point).alias("values"))
    labels = F.create_map(F.lit("app"), F.split_part("metric_name", F.lit("_"), F.lit(1)))
    docs = lists.select(
        "case_id", F.regexp_replace("metric_name", "^[^_]+_", "").alias("metric_name"), F.lit("q").alias("query"),
        F.array(F.struct(labels.alias("metric"), "values")).alias("data"),
    )
    docs.write.partitionBy("case_id").json(f"{root}/matrix")
    return captures.read_promql_matrix(spark, f"{root}/matrix", multi_line=False).select("case_id", "metric_name", *rounded("ts", digits=3), "value")


@register("SELECT case_id, trace_id, span_id, parent_id, service, operation, start_us, duration_us FROM v_spans")
def read_trace_json(spark, sf):
    root = scratch_path(spark, "files")
    ref = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_id").alias("spanID"))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("operation").alias("operationName"),
        F.when(F.col("parent_id").isNotNull(), F.array(ref)).otherwise(F.array()).alias("references"),
        F.col("start_us").alias("startTime"), F.col("duration_us").alias("duration"),
        F.concat(F.lit("p-"), "service").alias("processID"),
    )
    d = plain_spans(spark, sf).withColumn("piece", F.floor(F.col("seq") / 8))
    docs = d.groupBy("case_id", "trace_id", "piece").agg(
        F.collect_list(span).alias("spans"),
        F.map_from_entries(
            F.collect_set(F.struct(F.concat(F.lit("p-"), "service"), F.struct(F.col("service").alias("serviceName"))))
        ).alias("processes"),
    )
    # Pieces of a trace land in several captures, and every fourth piece in two of them.
    docs = docs.withColumn("copy", F.explode(F.when(F.col("piece") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    docs.select("case_id", F.array(F.struct(F.col("trace_id").alias("traceID"), "spans", "processes")).alias("data")).write.partitionBy(
        "case_id"
    ).json(f"{root}/traces", compression="gzip")
    return captures.read_trace_json(spark, f"{root}/traces", multi_line=False).select(
        "case_id", "trace_id", "span_id", "parent_id", "service", "operation", "start_us", "duration_us"
    )


@register(
    """SELECT case_id, service, concat(substr(line, 2, position(']' IN line) - 2), ' ', message) AS line FROM lines WHERE ts >= 1705708800.0 - 100 AND ts <= 1705708800.0 + 105"""
)
def read_container_logs(spark, sf):
    root = scratch_path(spark, "files")
    inv = investigation(spark, sf)
    line = F.concat(F.regexp_extract("line", r"^\[([^\]]+)\]", 1), F.lit(" "), "message")
    rows = inv.lines.select("case_id", "service", F.explode(F.array(line, F.lit("   "))).alias("value"))
    rows.write.partitionBy("case_id", "service").text(f"{root}/containers")
    span = inv.cases.select("case_id", (F.col("inject_time") - 100).alias("start_ts"), (F.col("inject_time") + 100).alias("end_ts"))
    return captures.read_container_logs(spark, f"{root}/containers", span).select("case_id", "service", "line")


@register("SELECT 'logs.parquet' AS file_name, case_id FROM v_logs UNION SELECT 'inject_time.txt', case_id FROM v_cases")
def list_files(spark, sf):
    root = scratch_path(spark, "files")
    inv = investigation(spark, sf)
    inv.raw_logs.write.partitionBy("case_id").parquet(f"{root}/logs.parquet")
    inv.cases.select("case_id", F.col("inject_time").cast("string")).write.partitionBy("case_id").text(f"{root}/inject_time.txt")
    return Cs.list_files(spark, root, "partitioned").filter("size_bytes > 0").select("file_name", "case_id").distinct()


@register(
    """SELECT 'logs' AS signal, case_id, phase, count(*) AS rows_kept FROM lines GROUP BY ALL
       UNION ALL SELECT 'metrics', case_id, phase, count(*) FROM points GROUP BY ALL"""
)
def write_snapshots(spark, sf):
    root = scratch_path(spark, "files")
    inv = investigation(spark, sf)
    R.write_snapshots({"logs": inv.lines, "metrics": inv.points}, inv.cases, root)
    back = lambda n: spark.read.schema("phase string, case_id string").json(f"{root}/{n}").select(F.lit(n).alias("signal"), "case_id", "phase")
    return back("logs").unionByName(back("metrics")).groupBy("signal", "case_id", "phase").agg(F.count(F.lit(1)).alias("rows_kept"))


@register(
    "SELECT case_id, mode, predicted_service, ranked_candidates, top1_hit, top3_hit, fault_match, error_bucket, round(CAST(mrr AS DOUBLE), 4) AS mrr FROM scores"
)
def append_and_read_scores(spark, sf):
    root = scratch_path(spark, "files")
    scores = investigation(spark, sf).scores
    R.append_scores(scores.filter("mode = 'fusion'"), root)
    R.append_scores(scores.filter("mode <> 'fusion'"), root)
    return R.read_scores(spark, root).select(
        "case_id", "mode", "predicted_service", F.array_join("ranked_candidates", ";").alias("ranked_candidates"),
        "top1_hit", "top3_hit", "fault_match", "error_bucket", *rounded("mrr"),
    )


@register(
    """SELECT d.case_id, d.mode, 'cache' AS source, d.top_service AS root_cause_service, length(c.context) AS context_chars
       FROM diagnosis d JOIN contexts c USING (case_id, mode)"""
)
def write_and_read_artifacts(spark, sf):
    root = scratch_path(spark, "files")
    artifacts = investigation(spark, sf).artifacts
    # The second write replaces exactly its own partitions.
    R.write_artifacts(artifacts, root)
    R.write_artifacts(artifacts.filter("mode = 'fusion'"), root)
    return R.read_artifacts(spark, root, artifacts.schema).select(
        "case_id", "mode", "source", "report.root_cause_service", F.length("prompt.preview").alias("context_chars")
    )

