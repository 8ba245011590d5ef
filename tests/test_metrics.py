from __future__ import annotations

from faultlens.operators import metrics as M

SCHEMA = "case_id string, phase string, metric_name string, query string, ts double, value double, seq long"


def points(spark, series):
    rows = []
    for (phase, name), values in series.items():
        start = 0.0 if phase == "baseline" else 1000.0
        rows += [("c", phase, name, "", start + 5.0 * i, float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def judged(spark, series):
    ev = M.evaluate(points(spark, series)).cache()
    found = M.alert_text(M.alerts(ev))
    top = M.top_alerts(found)
    return {r.metric_name: r for r in top.collect()}, M.metric_evidence(ev, found, top).first()


def test_spike_is_critical(spark):
    alerts, ev = judged(spark, {("baseline", "cart_cpu"): [10, 11] * 10, ("incident", "cart_cpu"): [10, 95, 11]})
    a = alerts["cart_cpu"]
    assert (a.severity, a.service, a.peak) == ("CRITICAL", "cart", 95.0) and a.z > 10
    assert ev.alerts == 1 and not ev.has_oom and not ev.has_latency
    assert a.description.startswith("Spike to 95.00 (baseline μ=10.50, σ=0.51, z=+")


def test_memory_slope_is_oom_risk(spark):
    mb = 1_000_000
    alerts, ev = judged(
        spark, {("baseline", "pay/memory"): [50 * mb] * 5, ("incident", "pay/memory"): [50 * mb, 100 * mb, 150 * mb]}
    )
    a = alerts["pay/memory"]
    assert a.is_oom_risk and a.severity == "CRITICAL" and a.slope > 5 * mb and ev.has_oom


def test_flat_latency_baseline(spark):
    alerts, ev = judged(spark, {("baseline", "web_latency"): [0.05] * 10, ("incident", "web_latency"): [0.05, 3.5]})
    assert list(alerts) == ["web_latency"] and ev.has_latency


def test_limit_gives_time_to_oom_without_baseline(spark):
    mb = 1_000_000
    alerts, ev = judged(
        spark,
        {
            ("incident", "db/spec_memory_limit"): [200 * mb] * 4,
            ("incident", "db/memory_rss"): [150 * mb, 160 * mb, 170 * mb, 180 * mb],
        },
    )
    assert alerts["db/memory_rss"].time_to_oom < 300 and ev.has_oom
    assert ev.metrics_evaluated == 2


def test_self_baseline_takes_first_third_but_two_at_least(spark):
    p = points(spark, {("incident", "a_x"): [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], ("incident", "b_x"): [5], ("baseline", "c_x"): [1], ("incident", "c_x"): [2]})
    stats = {r.metric_name: (r.n, r.mean, r.median, r.mad, r.std) for r in M.self_baseline(p).collect()}
    assert stats == {"a_x": (3, 2.0, 2.0, 1.0, 1.0), "b_x": (1, 5.0, 5.0, 0.0, 0.0)}


def test_calm_case_has_text(spark):
    alerts, ev = judged(spark, {("baseline", "a_x"): [1, 2, 3, 2], ("incident", "a_x"): [2, 2]})
    assert not alerts and ev.alerts == 0 and ev.text.startswith("No metric anomalies")
