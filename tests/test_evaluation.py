from __future__ import annotations

from faultlens import constants as K
from faultlens.operators import evaluation as E
from faultlens.operators import windows as W


def reports(spark, rows):
    return spark.createDataFrame(
        [(c, "fusion", s[0], s, cat, 0.8) for c, s, cat in rows],
        "case_id string, mode string, root_cause_service string, culprit_services array<string>, category string, confidence double",
    )


def truth(spark, *cases):
    return spark.createDataFrame([(c, "Cart ", f) for c, f in cases], "case_id string, gt_service string, gt_fault string")


def test_ranks_and_buckets(spark):
    r = reports(
        spark,
        [("c1", ["cart", "x"], K.EC1), ("c2", ["x", " CART"], K.EC1), ("c3", ["x", "y", "z"], K.EC1), ("c4", ["cart"], K.EC2), ("c5", ["x"], K.EC3)],
    )
    s = E.score_cases(r, truth(spark, *[(f"c{i}", "mem") for i in range(1, 6)]))
    got = {x.case_id: (x.top1_hit, x.top3_hit, x.mrr, x.error_bucket) for x in s.collect()}
    assert got == {
        "c1": (True, True, 1.0, "hit"), "c2": (False, True, 0.5, "ranking_miss"), "c3": (False, False, 0.0, "localization_miss"),
        "c4": (True, True, 1.0, "category_miss"), "c5": (False, False, 0.0, "localization_and_category_miss"),
    }
    total = E.aggregate_scores(s).filter("fault IS NULL").first()
    assert (total.cases, total.top1, total.top3, round(total.mrr, 3), total.fault_acc) == (5, 0.4, 0.6, 0.5, 0.6)
    assert E.aggregate_scores(s).filter("fault = 'MEM'").count() == 1
    label = E.fault_breakdown(s).first()
    assert (label.fault, label.label, label.top1_pct) == ("mem", "Memory Pressure", 40.0)


def test_unknown_label_never_matches(spark):
    s = E.score_cases(reports(spark, [("c1", ["cart"], K.UNKNOWN_CATEGORY)]), truth(spark, ("c1", "odd")))
    assert s.first().fault_match is False


def test_pending_and_backfill(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    scores = spark.createDataFrame([("a", "fusion"), ("b", "fusion")], "case_id string, mode string")
    artifacts = spark.createDataFrame([("a", "fusion")], "case_id string, mode string")
    assert W.pending(cases, ("fusion",), scores, artifacts).count() == 0
    (row,) = W.pending(cases, ("fusion",), scores, artifacts, backfill=True).collect()
    assert (row.case_id, row.keep_score) == ("b", True)
    assert W.pending(cases, ("fusion", "logs-only"), scores, artifacts).count() == 2


def test_lookup_falls_back_to_scores(spark):
    cols = "case_id string, mode string, predicted_service string, top1_hit boolean, top3_hit boolean, mrr double, confidence double"
    scores = spark.createDataFrame([("a", "fusion", "s", True, True, 1.0, 0.9), ("b", "fusion", "s", True, True, 1.0, 0.9)], cols)
    stored = scores.filter("case_id = 'a'")
    cases = spark.createDataFrame([("a",), ("b",), ("d",)], "case_id string")
    got = {(r.case_id, r.mode): r.source for r in E.best_result(cases, stored, scores).collect()}
    assert len(got) == 12
    assert (got[("a", "fusion")], got[("b", "fusion")], got[("d", "fusion")]) == ("cache", "csv_summary", "absent")
    assert E.mode_coverage(cases, scores).filter("scored").count() == 2


def test_ground_truth_registry_first(spark):
    cases = spark.createDataFrame([("re2ob_cart_cpu_1",), ("re2ob_pay_mem_1",)], "case_id string")
    registry = spark.createDataFrame([("re2ob_cart_cpu_1", "other", "disk", "D")], "case_id string, gt_service string, gt_fault string, dataset string")
    got = {r.case_id: (r.gt_service, r.gt_fault, r.suite) for r in E.ground_truth(cases, registry).collect()}
    assert got == {"re2ob_cart_cpu_1": ("other", "disk", "RE2OB"), "re2ob_pay_mem_1": ("pay", "MEM", "RE2OB")}
