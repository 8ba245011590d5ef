"""Trace evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.operators import traces as T
from queries.common import investigation, rounded, rounded_sql

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


@register(
    """SELECT span_id, CASE WHEN parent_id IS NOT NULL THEN parent_id END AS parent_id FROM v_spans"""
)
def parent_of(spark, sf):
    from faultlens.functions.spans import parent_of as parent

    ref = lambda kind, span: F.struct(F.lit(kind).alias("refType"), F.col("trace_id").alias("traceID"), span.alias("spanID"))
    refs = F.when(
        F.col("parent_id").isNotNull(),
        F.array(ref("LINKED", F.lit("other")), ref("FOLLOWS_FROM", F.col("parent_id")), ref("CHILD_OF", F.lit("later"))),
    ).otherwise(F.array(ref("LINKED", F.lit("other"))))
    return investigation(spark, sf).raw_spans.select("span_id", parent(refs).alias("parent_id"))


@register("SELECT span_id, has_parent, parent_service, parent_duration_us, parent_timeout FROM links")
def link_spans(spark, sf):
    inv = investigation(spark, sf)
    links = T.link_spans(inv.slim_spans.filter("phase = 'incident'"))
    return links.select("span_id", "has_parent", "parent_service", "parent_duration_us", "parent_timeout")


@register("SELECT case_id, caller, string_agg(callee, ',' ORDER BY callee) AS callees FROM edges GROUP BY ALL")
def service_edges(spark, sf):
    return T.callee_lists(investigation(spark, sf).edges).withColumn("callees", F.array_join("callees", ","))


@register("SELECT case_id, trace_id, span_id, service FROM links WHERE NOT has_parent")
def roots(spark, sf):
    inv = investigation(spark, sf)
    links = T.link_spans(inv.slim_spans.filter("phase = 'incident'"))
    return T.roots(links).select("case_id", "trace_id", "span_id", "service")


@register("SELECT case_id, trace_id, span_id, depth, array_to_string(path, '.') AS path FROM depths")
def span_depth(spark, sf):
    inv = investigation(spark, sf)
    marked = T.mark_roots(T.link_spans(inv.slim_spans.filter("phase = 'incident'")))
    depth = T.span_depth(marked, with_path=True)
    return depth.select("case_id", "trace_id", "span_id", "depth", F.array_join("path", ".").alias("path"))


@register(f"SELECT case_id, trace_id, span_id, {rounded_sql('self_ms')} FROM selfs")
def self_time(spark, sf):
    return investigation(spark, sf).facts.select("case_id", "trace_id", "span_id", *rounded("self_ms"))


@register("SELECT case_id, trace_id, span_id, status AS status_code FROM inc_spans WHERE is_error")
def error_spans(spark, sf):
    return T.error_spans(investigation(spark, sf).facts).select("case_id", "trace_id", "span_id", "status_code")


@register("SELECT case_id, trace_id, span_id, parent_id FROM facts WHERE is_timeout_child")
def timeout_children(spark, sf):
    return T.timeout_children(investigation(spark, sf).facts).select("case_id", "trace_id", "span_id", "parent_id")


@register(f"SELECT case_id, service, operation, spans, {rounded_sql('p99_ms')} FROM p99s")
def baseline_p99(spark, sf):
    inv = investigation(spark, sf)
    return T.baseline_p99(inv.slim_spans.filter("phase = 'baseline'")).select(
        "case_id", "service", "operation", "spans", *rounded("p99_ms")
    )


@register(f"SELECT case_id, trace_id, span_id, {rounded_sql('self_ms', 'p99_ms')} FROM facts WHERE is_bottleneck")
def bottlenecks(spark, sf):
    return investigation(spark, sf).facts.filter("is_bottleneck").select(
        "case_id", "trace_id", "span_id", *rounded("self_ms", "p99_ms")
    )


@register("SELECT case_id, trace_id, span_id, service, depth, class FROM leafs")
def leaf_culprit(spark, sf):
    return investigation(spark, sf).leafs.select("case_id", "trace_id", "span_id", "service", "depth", "class")


@register("SELECT case_id, culprit_service, votes, culprit_trace_id, culprit_span_id, span_service, leaf_depth FROM culprits")
def trace_culprit(spark, sf):
    return T.trace_culprit(investigation(spark, sf).leafs).select(
        "case_id", "culprit_service", "votes", "culprit_trace_id", "culprit_span_id", "span_service", "leaf_depth"
    )


@register(
    """SELECT case_id, kind, evidence_rank, trace_id, span_id FROM (
         SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY trace_start_us, trace_id, seq, span_id) AS evidence_rank FROM (
           SELECT *, 'error' AS kind FROM facts WHERE is_error UNION ALL SELECT *, 'bottleneck' AS kind FROM facts WHERE is_bottleneck))
       WHERE evidence_rank <= 50"""
)
def top_span_evidence(spark, sf):
    return T.top_span_evidence(investigation(spark, sf).facts).select("case_id", "kind", "evidence_rank", "trace_id", "span_id")


@register("SELECT case_id, traces, spans, error_spans, bottlenecks, root_service, culprit_service FROM trace_ev")
def trace_evidence(spark, sf):
    return investigation(spark, sf).trace_evidence.select(
        "case_id", "traces", "spans", "error_spans", "bottlenecks", "root_service", "culprit_service"
    )


@register("SELECT case_id, trace_rank, array_to_string(path, '.') AS path, line FROM tree_lines")
def call_tree(spark, sf):
    return investigation(spark, sf).call_tree.select("case_id", "trace_rank", F.array_join("path", ".").alias("path"), "line")


@register("SELECT case_id, trace_id, span_id FROM v_spans")
def dedup_traces(spark, sf):
    spans = investigation(spark, sf).raw_spans
    return T.dedup_traces(spans.unionByName(spans.filter("duration_us > 100000"))).select("case_id", "trace_id", "span_id")


@register("SELECT case_id, text, length(text) AS text_chars FROM trace_texts")
def trace_text(spark, sf):
    inv = investigation(spark, sf)
    return T.trace_text(inv.trace_evidence, T.call_tree_text(inv.call_tree))
