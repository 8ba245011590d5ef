from __future__ import annotations

import random

from faultlens import constants as K
from faultlens.operators import fusion as Fu

GRAPH = "case_id string, caller string, callee string, first_call struct<trace_start_us: long, trace_id: string, seq: long>"


def test_closed_form_equals_one_caller_after_the_other(spark):
    rng = random.Random(11)
    base_rows, edge_rows, want = [], [], {}
    for case in range(40):
        names = [f"s{i}" for i in range(rng.randrange(2, 7))]
        scores = {n: float(rng.randrange(1, 20)) for n in names if rng.random() < 0.8}
        edges = sorted({(a, b) for a in names for b in names if a != b and rng.random() < 0.35})
        base_rows += [(f"c{case}", "fusion", n, v) for n, v in scores.items()]
        rng.shuffle(edges)
        edge_rows += [(f"c{case}", a, b, (i, "t", i)) for i, (a, b) in enumerate(edges)]
        now = dict(scores)
        for caller in dict.fromkeys(a for a, _ in edges):
            hit = [b for a, b in edges if a == caller and b in now]
            if caller in now and hit:
                now[caller] *= 0.60
                for b in hit:
                    now[b] += 2.0
        want |= {(f"c{case}", n): v for n, v in now.items()}
    base = spark.createDataFrame(base_rows, "case_id string, mode string, service string, base double")
    edges = spark.createDataFrame(edge_rows, GRAPH)
    got = {(r.case_id, r.service): r.score for r in Fu.propagate(base, edges).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def inputs(spark, logs=(), alerts=(), traces=()):
    kept = spark.createDataFrame(
        [("c", s, 1, n, k, i, q, 10, r + 1) for r, (s, k, n, i, q) in enumerate(logs)],
        "case_id string, service string, total_lines long, novel_templates long, snippets long, infra_hits long, silent_hits long, tokens long, budget_rank int",
    )
    top = spark.createDataFrame(
        [("c", s, m, sev, oom, tto, z, abs(z), r + 1) for r, (s, m, sev, oom, tto, z) in enumerate(alerts)],
        "case_id string, service string, metric_name string, severity string, is_oom_risk boolean, time_to_oom double, z double, divergence double, alert_rank int",
    )
    metrics = spark.createDataFrame(
        [("c", any(a[3] for a in alerts), any("latency" in a[1] for a in alerts))], "case_id string, has_oom boolean, has_latency boolean"
    )
    ev = spark.createDataFrame(
        [("c", 5, 9, e, b, s, d, s, "op", 500, "t", "x") for (s, e, b, d) in traces],
        "case_id string, traces long, spans long, error_spans long, bottlenecks long, culprit_service string, leaf_depth int, "
        "span_service string, span_operation string, span_status_code int, culprit_trace_id string, culprit_span_id string",
    )
    return kept, top, metrics, ev


def diagnose(spark, edges=(), mode="fusion", **kw):
    cases = spark.createDataFrame([("c",)], "case_id string")
    kept, top, metrics, ev = inputs(spark, **kw)
    graph = spark.createDataFrame([("c", a, b, (i, "t", i)) for i, (a, b) in enumerate(edges)], GRAPH)
    ranked = Fu.ranking(kept, top, ev, graph)
    signals = Fu.case_signals(cases, kept, metrics, top, ev)
    d = Fu.primary_signal(Fu.confidence(Fu.with_ranking(Fu.category(Fu.category_likelihoods(signals)), ranked)))
    return Fu.rca_report(Fu.triangulation(d, kept, top)).filter(f"mode = '{mode}'").first()


def test_callee_with_trace_leaf_outranks_noisy_caller(spark):
    r = diagnose(spark, edges=[("front", "pay")], logs=[("front", 2, 1, 0, 0)], traces=[("pay", 2, 0, 1)])
    assert r.culprit_services[0] == "pay" and r.category == K.EC3 and r.confidence >= 0.50
    assert r.traces_insight.startswith("DFS DAG traversal isolated deepest leaf culprit at 'pay:op'")


def test_caller_and_callee_both_log(spark):
    r = diagnose(spark, edges=[("a", "b")], logs=[("a", 3, 2, 0, 0), ("b", 3, 2, 0, 0)], traces=[("b", 1, 0, 0)])
    assert r.culprit_services == ["b", "a"]


def test_no_evidence_is_silent(spark):
    r = diagnose(spark)
    assert r.category == K.EC4 and r.culprit_services == ["unknown"] and r.confidence == 0.50 and r.primary_signal == "FUSION"


def test_three_agreeing_signals_are_confident(spark):
    r = diagnose(spark, logs=[("pay", 4, 3, 0, 0)], alerts=[("pay", "pay_mem", "CRITICAL", True, 60.0, 20.0)], traces=[("pay", 1, 0, 1)])
    assert r.category == K.EC1 and r.confidence >= 0.90 and r.primary_signal == "FUSION" and r.agreeing == 3
    weak = diagnose(spark, mode="logs-only", logs=[("pay", 1, 0, 0, 0)])
    assert 0.50 <= weak.confidence <= 0.75 and weak.primary_signal == "LOGS"


def test_modes_mask_signals(spark):
    kw = {"logs": [("l", 1, 0, 0, 0)], "alerts": [("m", "m_cpu", "HIGH", False, None, 6.0)], "traces": [("t", 1, 0, 0)]}
    seen = {m: set(diagnose(spark, mode=m, **kw).culprit_services) for m in K.MODES}
    assert seen == {"logs-only": {"l"}, "logs-metrics": {"l", "m"}, "logs-traces": {"l", "t"}, "fusion": {"l", "m", "t"}}


def test_lone_plain_alert_is_unknown(spark):
    r = diagnose(spark, mode="logs-metrics", alerts=[("m", "m_cpu", "MEDIUM", False, None, 3.5)])
    assert r.category == K.UNKNOWN_CATEGORY


def test_phrases_raise_infra_and_silent(spark):
    infra = diagnose(spark, mode="logs-only", logs=[("a", 4, 0, 4, 0)])
    assert infra.category == K.EC5
    silent = diagnose(spark, mode="logs-only", logs=[("a", 4, 0, 0, 4)])
    assert silent.category == K.EC4
