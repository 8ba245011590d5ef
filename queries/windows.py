"""Phases, buckets, samples, discovery and pending work."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.operators import windows as W
from faultlens.plans import views
from faultlens.plans.materialize import scratch_path
from faultlens.sources.bounds import bounds_of
from faultlens.sources.cases import list_files
from queries.common import investigation

QUERIES, SQL = {}, {}

FILES_SQL = """SELECT case_id, 'logs.parquet' AS file_name FROM v_logs UNION SELECT case_id, 'metrics.parquet' FROM v_points
 UNION SELECT case_id, 'traces.parquet' FROM v_spans UNION SELECT case_id, 'inject_time.txt' FROM v_cases WHERE gt_fault <> 'disk'"""


def written_files(spark, inv):
    """Writes the files of every case, but for the injection file of one of them, and lists what is there."""
    root = scratch_path(spark, "files")
    for df, name in ((inv.raw_logs, "logs"), (inv.raw_points, "metrics"), (inv.raw_spans, "traces")):
        df.write.partitionBy("case_id").parquet(f"{root}/{name}.parquet")
    marks = inv.cases.filter("gt_fault <> 'disk'").select("case_id", F.col("inject_time").cast("string"))
    marks.write.partitionBy("case_id").text(f"{root}/inject_time.txt")
    return list_files(spark, root, "partitioned")


def label_phase(spark, sf):
    inv = investigation(spark, sf)
    within = bounds_of(inv.cases, 300.0, 200.0)
    return W.label_phase(inv.raw_logs, inv.cases, 300.0, 200.0, within).select("case_id", "seq", "phase")


def label_trace_phase(spark, sf):
    inv = investigation(spark, sf)
    return W.label_trace_phase(inv.raw_spans, inv.cases, 400.0, 200.0).select("case_id", "span_id", "phase", "trace_start_us")


def number_lines(spark, sf):
    return investigation(spark, sf).lines.select("case_id", "phase", "service", "line_no", "line")


def time_buckets(spark, sf):
    inv = investigation(spark, sf)
    b = W.time_buckets(
        inv.raw_logs, inv.raw_points, inv.raw_spans, inv.cases, K.BUCKET_SECONDS, views.BASELINE_SECONDS, views.INCIDENT_SECONDS
    )
    return b.withColumn("services", F.array_join("services", ",")).withColumns({"start_ts": F.round("start_ts", 3), "end_ts": F.round("end_ts", 3)})


def _by_row(inv):
    ts = F.col("start_us") / 1e6
    return inv.raw_spans.withColumn("ts", ts).transform(W.label_phase, inv.cases, views.BASELINE_SECONDS, views.INCIDENT_SECONDS).drop("ts")


def sample_traces(spark, sf):
    inv = investigation(spark, sf)
    return W.sample_traces(_by_row(inv), 50, 30).select("case_id", "trace_id", "span_id")


def sample_rows(spark, sf):
    inv = investigation(spark, sf)
    return W.sample_rows(_by_row(inv), rows=400, incident_rows=240).select("case_id", "span_id", "phase")


def discover_cases(spark, sf):
    inv = investigation(spark, sf)
    return W.discover_cases(inv.cases, written_files(spark, inv), suites=["re2-ob"], faults=["CPU", "mem", "disk", "Loss", "corrupt", "socket"]).select(
        "case_id", "dataset", "gt_service", "gt_fault"
    )


def _done(inv):
    """Pairs that count as scored: those whose case has an error event from an even user, in two modes."""
    hits = inv.raw_logs.filter("message LIKE 'error%' AND service IN ('svc2', 'svc4')").select("case_id").distinct()
    return W.with_mode(hits.filter("case_id LIKE '%u%'"), ("logs-only", "fusion"))


DONE_SQL = "SELECT DISTINCT case_id, mode FROM v_logs, (SELECT unnest(['logs-only', 'fusion']) AS mode) WHERE message LIKE 'error%' AND service IN ('svc2', 'svc4') AND case_id LIKE '%u%'"


def pending(spark, sf):
    inv = investigation(spark, sf)
    scores = _done(inv)
    artifacts = scores.filter("mode = 'fusion'")
    plain = W.pending(inv.cases, K.MODES, scores, artifacts).withColumn("backfill", F.lit(False))
    again = W.pending(inv.cases, K.MODES, scores, artifacts, backfill=True).withColumn("backfill", F.lit(True))
    return plain.unionByName(again)


QUERIES.update(
    label_phase=label_phase, label_trace_phase=label_trace_phase, number_lines=number_lines, time_buckets=time_buckets,
    sample_traces=sample_traces, sample_rows=sample_rows, discover_cases=discover_cases, pending=pending,
)

T = f"{views.INJECT_SECONDS}.0"
SQL["label_phase"] = f"""SELECT case_id, seq, CASE WHEN ts < {T} THEN 'baseline' ELSE 'incident' END AS phase FROM v_logs WHERE ts >= {T} - 300 AND ts <= {T} + 200"""
SQL["label_trace_phase"] = f"""SELECT case_id, span_id, CASE WHEN t0 < {T} THEN 'baseline' ELSE 'incident' END AS phase, us AS trace_start_us FROM
 (SELECT *, min(start_us) OVER (PARTITION BY case_id, trace_id) AS us, min(start_us) OVER (PARTITION BY case_id, trace_id) / 1000000.0 AS t0 FROM v_spans)
 WHERE t0 >= {T} - 400 AND t0 <= {T} + 200"""
SQL["number_lines"] = "SELECT case_id, phase, service, line_no, line FROM lines"
SQL["time_buckets"] = f"""SELECT case_id, CAST(b AS BIGINT) AS bucket_index, round({T} + b * 5, 3) AS start_ts, round({T} + b * 5 + 5, 3) AS end_ts,
 count(*) FILTER (WHERE kind = 'l') AS log_count, count(*) FILTER (WHERE kind = 'm') AS metric_points_count, count(*) FILTER (WHERE kind = 's') AS span_count,
 array_to_string(list_sort(list(DISTINCT service)), ',') AS services
 FROM (SELECT *, floor((ts - {T}) / 5) AS b FROM (
   SELECT case_id, ts, service, 'l' AS kind FROM v_logs UNION ALL
   SELECT case_id, ts, CASE WHEN contains(metric_name, '/') THEN split_part(metric_name, '/', 1) ELSE 'system' END, 'm' FROM v_points UNION ALL
   SELECT case_id, start_us / 1000000.0, service, 's' FROM v_spans)
   WHERE ts >= {T} - {views.BASELINE_SECONDS} AND ts <= {T} + {views.INCIDENT_SECONDS}) GROUP BY case_id, b"""
ROWS = f"(SELECT *, CASE WHEN start_us / 1000000.0 < {T} THEN 'baseline' ELSE 'incident' END AS ph FROM v_spans)"
SQL["sample_traces"] = f"""WITH r AS {ROWS}, picks AS (SELECT DISTINCT case_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, ph ORDER BY md5(concat(case_id, '|', trace_id, '|42')), trace_id) AS i
           FROM (SELECT DISTINCT case_id, ph, trace_id FROM r)) WHERE i <= CASE WHEN ph = 'incident' THEN 50 ELSE 30 END)
 SELECT r.case_id, r.trace_id, r.span_id FROM r WHERE (r.case_id, r.trace_id) IN (SELECT (case_id, trace_id) FROM picks)"""
SQL["sample_rows"] = f"""WITH r AS {ROWS}, z AS (SELECT case_id, least(240, count(*) FILTER (WHERE ph = 'incident')) AS k FROM r GROUP BY 1)
 SELECT case_id, span_id, ph AS phase FROM (SELECT r.*, k, row_number() OVER (PARTITION BY case_id, ph ORDER BY md5(concat(case_id, '|', span_id, '|42')), span_id) AS i
 FROM r JOIN z USING (case_id)) WHERE i <= CASE WHEN ph = 'incident' THEN k ELSE 400 - k END"""
SQL["discover_cases"] = f"""SELECT case_id, dataset, gt_service, gt_fault FROM v_cases WHERE has_logs AND has_traces AND upper(dataset) = 'RE2-OB'
 AND lower(gt_fault) IN ('cpu', 'mem', 'disk', 'loss', 'corrupt', 'socket')
 AND case_id IN (SELECT case_id FROM ({FILES_SQL}) GROUP BY case_id HAVING count(DISTINCT file_name) = 4)"""
SQL["pending"] = f"""WITH done AS ({DONE_SQL}), pairs AS (SELECT p.case_id, p.mode, d.case_id IS NOT NULL AS keep_score FROM case_modes p LEFT JOIN done d USING (case_id, mode))
 SELECT *, false AS backfill FROM pairs WHERE NOT keep_score UNION ALL
 SELECT *, true AS backfill FROM pairs WHERE NOT keep_score OR mode <> 'fusion'"""
