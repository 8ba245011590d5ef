from __future__ import annotations

from faultlens.functions.spans import SPAN_LOGS, TAGS
from faultlens.operators import traces as T

SCHEMA = (
    "case_id string, phase string, trace_id string, span_id string, parent_id string, service string, operation string, "
    f"start_us bigint, trace_start_us bigint, duration_us bigint, tags {TAGS}, logs {SPAN_LOGS}, seq bigint"
)


def span(sid, parent, service, ms, status=None, trace="t1", phase="incident", seq=None, op="op"):
    tags = [("service.name", service)] + ([("http.status_code", str(status))] if status else [])
    return ("c", phase, trace, sid, parent, service, op, 1000, 1000, int(ms * 1000), tags, [], seq if seq is not None else int(sid.strip("abcdefghijklmnopqrstuvwxyz-") or 0))


def study(spark, rows):
    facts = T.span_facts(T.with_error_facts(spark.createDataFrame(rows, SCHEMA)))
    leafs = T.leaf_culprit(facts)
    return facts, leafs, T.trace_evidence(facts, leafs).first()


def test_three_tier_cascade(spark):
    facts, leafs, ev = study(spark, [span("s1", None, "front", 300, 500), span("s2", "s1", "check", 200, 503), span("s3", "s2", "pay", 100, 14)])
    assert (ev.root_service, ev.culprit_service, ev.leaf_depth, ev.error_spans) == ("front", "pay", 2, 3)
    assert {(r.caller, r.callee) for r in T.service_edges(facts).collect()} == {("front", "check"), ("check", "pay")}
    lines = [r.line for r in T.call_tree(facts, leafs).orderBy("trace_rank", "path").collect()]
    assert lines == [
        "Trace t1:", "front:op (300.0ms) [ERROR 500]", "  ↳ check:op (200.0ms) [ERROR 503]",
        "    ↳ pay:op (100.0ms) [ERROR 14] <--- [LEAF CULPRIT]",
    ]
    text = T.trace_text(T.trace_evidence(facts, leafs), T.call_tree_text(T.call_tree(facts, leafs))).first()
    assert text.text.endswith("Call Hierarchy DAG:\n" + "\n".join(lines)) and text.text_chars == len(text.text)


def test_clean_trace(spark):
    facts, leafs, ev = study(spark, [span("s1", None, "front", 30, 200), span("s2", "s1", "check", 20, 200)])
    assert ev.culprit_service is None and ev.error_spans == 0
    text = T.trace_text(T.trace_evidence(facts, leafs), T.call_tree_text(T.call_tree(facts, leafs))).first().text
    assert text == "Evaluated 1 distributed traces. No span error codes or anomalies detected."


def test_timeout_inversion_blames_child(spark):
    facts, _, ev = study(spark, [span("s1", None, "front", 5050, 504), span("s2", "s1", "slow", 5000)])
    assert ev.culprit_service == "slow"
    assert {(r.caller, r.callee) for r in T.service_edges(facts).collect()} == {("front", "slow")}


def test_latency_bottleneck(spark):
    rows = [span("s1", None, "db", 10 + i, trace=f"b{i}", phase="baseline") for i in range(5)]
    rows += [span("s1", None, "front", 260, op="get"), span("s2", "s1", "db", 250)]
    _, _, ev = study(spark, rows)
    assert (ev.bottlenecks, ev.culprit_service, ev.error_spans) == (1, "db", 0)


def test_depth_of_long_chain_cycles_and_orphans(spark):
    rows = [span(f"s{i}", f"s{i - 1}" if i else None, "a", 1, trace="chain", seq=i) for i in range(70)]
    # A pure cycle has no root: its first span becomes one. A cycle beside a root is never reached.
    rows += [span("x1", "x3", "a", 1, trace="ring", seq=1), span("x2", "x1", "a", 1, trace="ring", seq=2), span("x3", "x2", "a", 1, trace="ring", seq=3)]
    rows += [span("r0", None, "a", 1, trace="mix", seq=0), span("y1", "y2", "a", 1, trace="mix", seq=1), span("y2", "y1", "a", 1, trace="mix", seq=2)]
    rows += [span("o1", "gone", "a", 1, trace="orphan", seq=1), span("o2", "o1", "a", 1, trace="orphan", seq=2)]
    facts, _, _ = study(spark, rows)
    depth = {(r.trace_id, r.span_id): (r.depth, r.reached) for r in facts.collect()}
    assert all(depth[("chain", f"s{i}")] == (i, True) for i in range(70))
    assert [depth[("ring", f"x{i}")] for i in (1, 2, 3)] == [(0, True), (1, True), (2, True)]
    assert depth[("mix", "r0")] == (0, True) and depth[("mix", "y1")] == depth[("mix", "y2")] == (0, False)
    assert depth[("orphan", "o1")][0] == 0 and depth[("orphan", "o2")][0] == 1


def test_vote_beats_depth_and_lists_are_capped(spark):
    rows = []
    for i in range(60):
        rows += [span("s1", None, "front", 10, trace=f"t{i:02d}"), span("s2", "s1", "cart", 5, 500, trace=f"t{i:02d}")]
    rows += [span("s1", None, "front", 10, trace="z"), span("s2", "s1", "cart", 9, trace="z"), span("s3", "s2", "deep", 8, 500, trace="z")]
    facts, _, ev = study(spark, rows)
    assert (ev.culprit_service, ev.votes, ev.span_service, ev.leaf_depth) == ("cart", 180, "deep", 2)
    assert T.top_span_evidence(facts).count() == 50


def test_repeated_span_id_counts_every_error(spark):
    _, _, ev = study(spark, [span("s1", None, "a", 10), span("s2", "s1", "b", 5, 500, seq=2), span("s2", "s1", "b", 7, 500, seq=3)])
    assert ev.error_spans == 2


def test_links_are_not_shuffled_for_few_limits_or_rootless_traces(spark, monkeypatch):
    plans, store = {}, T.materialize

    def kept(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(T, "materialize", kept)
    rows = [span("s1", None, "front", 30), span("s2", "s1", "check", 20), span("x1", "x2", "loop", 5, trace="t2"), span("x2", "x1", "loop", 5, trace="t2")]
    marked = T.mark_roots(T.link_spans(T.with_error_facts(spark.createDataFrame(rows, SCHEMA))))
    assert {r.span_id: r.is_root for r in marked.collect()} == {"s1": True, "s2": False, "x1": True, "x2": False}
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    plans.clear()
    T.span_facts(T.with_error_facts(spark.createDataFrame(rows, SCHEMA)))
    assert "p99" in plans and "hashpartitioning(case_id#" in plans["span-facts"]
    dealt = [line for line in plans["span-facts"].splitlines() if "hashpartitioning" in line]
    assert not any("service#" in line.split("hashpartitioning")[1].split("]")[0] for line in dealt)
