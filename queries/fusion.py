"""Fusion and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators import fusion as Fu
from faultlens.plans import views
from oracles.stages import fmt, truncate_sql
from queries.common import investigation, rounded, rounded_sql

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


@register(f"SELECT case_id, service, {rounded_sql('score')}, budget_rank FROM (SELECT *, r AS budget_rank FROM log_scores)")
def log_scores(spark, sf):
    return Fu.log_scores(investigation(spark, sf).kept_logs).select(
        "case_id", "service", *rounded("score"), F.col("ord.r").alias("budget_rank")
    )


@register(f"SELECT case_id, service, {rounded_sql('score')}, r AS first_alert FROM metric_scores")
def metric_scores(spark, sf):
    return Fu.metric_scores(investigation(spark, sf).top_alerts).select(
        "case_id", "service", *rounded("score"), F.col("ord.r").alias("first_alert")
    )


@register(f"SELECT case_id, service, {rounded_sql('score')} FROM trace_scores")
def trace_scores(spark, sf):
    return Fu.trace_scores(investigation(spark, sf).trace_evidence).select("case_id", "service", *rounded("score"))


def _base(inv):
    every = (
        Fu.log_scores(inv.kept_logs)
        .unionByName(Fu.metric_scores(inv.top_alerts))
        .unionByName(Fu.trace_scores(inv.trace_evidence))
    )
    return Fu.base_scores(Fu.with_modes(every))


@register(f"SELECT case_id, mode, service, {rounded_sql('base')}, in_logs, in_metrics, in_traces FROM base_scores")
def with_modes(spark, sf):
    return _base(investigation(spark, sf)).select(
        "case_id", "mode", "service", *rounded("base"), "in_logs", "in_metrics", "in_traces"
    )


@register(f"SELECT case_id, mode, service, {rounded_sql('score')} FROM propagated")
def propagate(spark, sf):
    inv = investigation(spark, sf)
    return Fu.propagate(_base(inv), inv.edges).select("case_id", "mode", "service", *rounded("score"))


@register(f"SELECT case_id, mode, service, signals, {rounded_sql('score')} FROM agreed")
def consensus(spark, sf):
    inv = investigation(spark, sf)
    return Fu.consensus(Fu.propagate(_base(inv), inv.edges)).select("case_id", "mode", "service", "signals", *rounded("score"))


@register(f"SELECT case_id, mode, rank, service, {rounded_sql('score')} FROM ranking")
def rank_services(spark, sf):
    return investigation(spark, sf).ranking.select("case_id", "mode", "rank", "service", *rounded("score"))


@register(f"SELECT case_id, mode, {rounded_sql(*Fu.LIKELIHOOD_COLUMNS)} FROM likelihoods")
def category_likelihoods(spark, sf):
    return Fu.category_likelihoods(investigation(spark, sf).signals).select("case_id", "mode", *rounded(*Fu.LIKELIHOOD_COLUMNS))


@register("SELECT case_id, mode, category FROM categories")
def category(spark, sf):
    return investigation(spark, sf).diagnosis.select("case_id", "mode", "category")


@register(f"SELECT case_id, mode, top_service, agreeing, {rounded_sql('support', 'margin', 'confidence')} FROM diagnosis")
def confidence(spark, sf):
    return investigation(spark, sf).diagnosis.select(
        "case_id", "mode", "top_service", "agreeing", *rounded("support", "margin", "confidence")
    )


@register("SELECT case_id, mode, primary_signal FROM diagnosis")
def primary_signal(spark, sf):
    return investigation(spark, sf).diagnosis.select("case_id", "mode", "primary_signal")


@register("SELECT case_id, mode, logs_insight, metrics_insight, traces_insight, reasoning FROM told")
def triangulation(spark, sf):
    return investigation(spark, sf).reports.select(
        "case_id", "mode", "logs_insight", "metrics_insight", "traces_insight", "reasoning"
    )


@register(
    f"""SELECT d.case_id, d.mode, top_service AS root_cause_service, culprits, category, {rounded_sql('confidence')},
        concat('Telemetry-RAG localized root cause to ''', top_service, ''' failing under ', category, '.') AS summary,
        concat('docker update --cpus=2.0 ', top_service) AS remediation_command
        FROM diagnosis d JOIN candidates3 USING (case_id, mode)"""
)
def rca_report(spark, sf):
    return investigation(spark, sf).reports.select(
        "case_id", "mode", "root_cause_service", F.array_join("culprit_services", ";").alias("culprits"), "category",
        *rounded("confidence"), "summary", "remediation_command",
    )


@register(
    f"""SELECT c.case_id, c.mode, coalesce(string_agg(concat(r.service, '=', {fmt('round(r.score, 4)', 4)}), ';' ORDER BY r.service), '') AS scores,
        coalesce(string_agg(r.service, ',' ORDER BY r.service) FILTER (WHERE in_logs), '') AS logs,
        coalesce(string_agg(r.service, ',' ORDER BY r.service) FILTER (WHERE in_metrics), '') AS metrics,
        coalesce(string_agg(r.service, ',' ORDER BY r.service) FILTER (WHERE in_traces), '') AS traces
        FROM case_modes c LEFT JOIN ranking r USING (case_id, mode) GROUP BY ALL"""
)
def fusion_debug(spark, sf):
    d = Fu.fusion_debug(investigation(spark, sf).diagnosis)
    pair = lambda e: F.concat(e["key"], F.lit("="), text.fixed(e["value"], 4))
    scores = F.array_join(F.transform(F.array_sort(F.map_entries("service_scores")), pair), ";")
    votes = lambda s: F.array_join(F.element_at("signal_votes", s), ",")
    return d.select(
        "case_id", "mode", scores.alias("scores"), votes("LOGS").alias("logs"), votes("METRICS").alias("metrics"),
        votes("TRACES").alias("traces"),
    )


@register("SELECT case_id, mode, header, trace_section, metric_section, log_section FROM sections")
def budget_sections(spark, sf):
    return investigation(spark, sf).sections


@register(
    f"""SELECT doc_id, {truncate_sql('text', '100')} AS cut FROM documents"""
)
def truncate_tokens(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.truncate_tokens(F.col("text"), F.lit(100)).alias("cut"))


@register(
    "SELECT case_id, mode, context, trace_tokens, metric_tokens, logs_tokens, greatest(1, length(context) // 3) AS total_tokens FROM contexts"
)
def build_context(spark, sf):
    return investigation(spark, sf).contexts


