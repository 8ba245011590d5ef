"""Metric evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import metrics as M
from queries.common import investigation, rounded, rounded_sql

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


STATS = ("mean", "std", "median", "mad")


@register(f"SELECT case_id, metric_name, n, {rounded_sql('mean', 'std')} FROM base_stats")
def mean_and_std(spark, sf):
    base = investigation(spark, sf).points.filter("phase = 'baseline'")
    stats = {"n": F.count("value"), **M.mean_std()}
    return base.groupBy(*M.METRIC).agg(*[c.alias(n) for n, c in stats.items()]).select(*M.METRIC, "n", *rounded("mean", "std"))


@register(f"SELECT case_id, metric_name, n, {rounded_sql(*STATS)} FROM base_stats")
def baseline_stats(spark, sf):
    return M.baseline_stats(investigation(spark, sf).points).select(*M.METRIC, "n", *rounded(*STATS))


@register(
    f"""WITH heads AS (SELECT case_id, metric_name, value FROM (
          SELECT *, row_number() OVER (PARTITION BY case_id, metric_name ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY case_id, metric_name) AS n
          FROM points WHERE phase = 'incident' AND NOT ends_with(metric_name, '_mem')) WHERE i <= greatest(2, floor(n * 0.3)))
        SELECT m.case_id, m.metric_name, m.n, {rounded_sql('m.mean', 'm.std', 'm.med', 'd.mad').replace('AS m.', 'AS ').replace('AS d.', 'AS ').replace('AS med', 'AS median')}
        FROM (SELECT case_id, metric_name, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, median(value) AS med FROM heads GROUP BY ALL) m
        JOIN (SELECT case_id, metric_name, median(abs(value - x)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY case_id, metric_name) AS x FROM heads) GROUP BY ALL) d
        USING (case_id, metric_name)"""
)
def self_baseline(spark, sf):
    # Baselines of all kinds but memory are withheld, so those series have to use their own head.
    points = investigation(spark, sf).points.filter("phase = 'incident' OR endswith(metric_name, '_mem')")
    held = points.filter("NOT (phase = 'incident' AND endswith(metric_name, '_mem'))")
    return M.self_baseline(held).select(*M.METRIC, "n", *rounded(*STATS))


@register(f"SELECT case_id, service, {rounded_sql('memory_limit')} FROM limits")
def memory_limits(spark, sf):
    return M.memory_limits(investigation(spark, sf).points).select("case_id", "service", *rounded("memory_limit"))


@register(f"SELECT case_id, metric_name, {rounded_sql('peak')} FROM peaks")
def peak(spark, sf):
    points = investigation(spark, sf).points
    return M.peak(points.filter("phase = 'incident'"), M.reference_stats(points)).select(*M.METRIC, *rounded("peak"))


@register(f"SELECT case_id, metric_name, {rounded_sql('z', 'robust_z')} FROM evaluated")
def z_scores(spark, sf):
    return investigation(spark, sf).evaluated.select(*M.METRIC, *rounded("z", "robust_z"))


@register(f"SELECT case_id, metric_name, {rounded_sql('slope')} FROM slopes")
def slope(spark, sf):
    return M.slope(investigation(spark, sf).points.filter("phase = 'incident'")).select(*M.METRIC, *rounded("slope"))


@register(f"SELECT case_id, metric_name, {rounded_sql('time_to_oom', 'slope')}, is_oom_risk FROM evaluated WHERE is_memory")
def oom_risk(spark, sf):
    return investigation(spark, sf).evaluated.filter("is_memory").select(*M.METRIC, *rounded("time_to_oom", "slope"), "is_oom_risk")


@register(f"SELECT case_id, metric_name, {rounded_sql('tau')} FROM evaluated")
def adaptive_tau(spark, sf):
    return investigation(spark, sf).evaluated.select(*M.METRIC, *rounded("tau"))


@register(f"SELECT case_id, metric_name, service, severity, is_oom_risk, latency_anomaly, {rounded_sql('divergence')} FROM alerts")
def alerts(spark, sf):
    return investigation(spark, sf).alerts.select(
        *M.METRIC, "service", "severity", "is_oom_risk", "latency_anomaly", *rounded("divergence")
    )


@register(f"SELECT case_id, alert_rank, metric_name, service, severity, {rounded_sql('peak', 'mean', 'z')} FROM top_alerts")
def top_alerts(spark, sf):
    return investigation(spark, sf).top_alerts.select(
        "case_id", "alert_rank", "metric_name", "service", "severity", *rounded("peak", "mean", "z")
    )


@register("SELECT case_id, metrics_evaluated, alerts, has_oom, has_latency, text FROM metric_ev")
def metric_evidence(spark, sf):
    return investigation(spark, sf).metric_evidence


@register("SELECT case_id, alert_rank, description, item FROM alert_texts")
def alert_text(spark, sf):
    return investigation(spark, sf).top_alerts.select("case_id", "alert_rank", "description", "item")


