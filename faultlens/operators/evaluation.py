"""Scores against ground truth, aggregates over them and result look-ups for all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import naming
from faultlens.operators.windows import with_mode

CASE_MODE = ["case_id", "mode"]
FILE_NAMES = K.CASE_FILES


def ground_truth(cases: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Truth per case: the registry's labels, else what the case id spells; plus the suite."""
    spelled = naming.truth_from_id(F.col("case_id"))
    d = cases.select("case_id").withColumn("__t", spelled)
    fallback = {
        "gt_service": F.col("__t.service"),
        "gt_fault": F.coalesce(F.col("__t.fault_upper"), F.lit("unknown")),
        "dataset": F.col("__t.dataset"),
    }
    if registry is not None:
        known = registry.select(
            "case_id",
            F.col("gt_service").alias("__s"),
            F.col("gt_fault").alias("__f"),
            F.col("dataset").alias("__d"),
            F.lit(True).alias("__known"),
        )
        d = d.join(known, "case_id", "left")
        pairs = {"gt_service": "__s", "gt_fault": "__f", "dataset": "__d"}
        fallback = {
            k: F.when(F.col("__known"), F.coalesce(F.col(pairs[k]), F.lit(""))).otherwise(v) for k, v in fallback.items()
        }
    return d.withColumns({**fallback, "suite": naming.suite_of(F.col("case_id"))}).select(
        "case_id", "gt_service", "gt_fault", "dataset", "suite"
    )


def score_cases(reports: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit at 1 and 3, reciprocal rank, category match and error bucket of every report."""
    clean = lambda c: F.lower(F.trim(c))
    d = reports.join(truth.select("case_id", "gt_service", "gt_fault"), "case_id")
    names = F.transform("culprit_services", clean)
    place = F.array_position(names, clean(F.coalesce("gt_service", F.lit(""))))
    d = d.withColumn("__p", F.coalesce(place, F.lit(0)))
    d = d.withColumns(
        {
            "top1_hit": F.col("__p") == 1,
            "top3_hit": F.col("__p").between(1, 3),
            "mrr": F.when(F.col("__p") > 0, 1.0 / F.nullif(F.col("__p"), F.lit(0))).otherwise(F.lit(0.0)),
            "fault_match": naming.fault_matches(F.col("category"), F.col("gt_fault")),
        }
    ).withColumn("error_bucket", naming.error_bucket(F.col("top1_hit"), F.col("top3_hit"), F.col("fault_match")))
    return d.select(
        *CASE_MODE,
        F.col("gt_service").alias("ground_truth_service"),
        F.col("root_cause_service").alias("predicted_service"),
        F.col("culprit_services").alias("ranked_candidates"),
        F.col("gt_fault").alias("ground_truth_fault"),
        F.col("category").alias("predicted_category"),
        "top1_hit", "top3_hit", "mrr", "fault_match", "error_bucket", "confidence",
        F.lit(K.LOCAL_ENGINE).alias("engine_type"),
    )


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))



def _rates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("cases"),
        share("top1_hit").alias("top1"),
        share("top3_hit").alias("top3"),
        F.avg("mrr").alias("mrr"),
        share("fault_match").alias("fault_acc"),
    ]


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """Rates per mode and per (mode, fault); the overall rows have a null fault."""
    label = F.when(F.coalesce("ground_truth_fault", F.lit("")) == "", F.lit("UNKNOWN")).otherwise(
        F.upper("ground_truth_fault")
    )
    d = scores.withColumn("fault", label)
    return d.groupingSets([[F.col("mode")], [F.col("mode"), F.col("fault")]], "mode", "fault").agg(*_rates())


def bucket_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("mode", "error_bucket").agg(F.count(F.lit(1)).alias("cases"))


def fault_breakdown(scores: DataFrame) -> DataFrame:
    """Rounded percentages per (mode, fault) with a readable label."""
    return (
        scores.groupBy("mode", F.col("ground_truth_fault").alias("fault"))
        .agg(*_rates())
        .select(
            "mode",
            "fault",
            naming.fault_label(F.col("fault")).alias("label"),
            F.col("cases").alias("total"),
            F.round(F.col("top1") * 100, 1).alias("top1_pct"),
            F.round(F.col("top3") * 100, 1).alias("top3_pct"),
            F.round("mrr", 4).alias("mrr"),
        )
    )


def mode_summary(results: DataFrame, mode: str) -> DataFrame:
    """Overall rates of one mode, its buckets and its faults, straight from the stored results."""
    own = results.filter(F.col("mode") == mode)
    overall = own.groupBy("mode").agg(*_rates()).select(
        "mode", F.lit("overall").alias("part"), F.lit("all").alias("name"), "cases", "top1", "top3", "mrr", "fault_acc"
    )
    none = F.lit(None).cast("double")
    buckets = bucket_counts(own).select(
        "mode", F.lit("bucket").alias("part"), F.col("error_bucket").alias("name"), "cases",
        none.alias("top1"), none.alias("top3"), none.alias("mrr"), none.alias("fault_acc"),
    )
    faults = own.groupBy("mode", F.col("ground_truth_fault").alias("name")).agg(*_rates()).select(
        "mode", F.lit("fault").alias("part"), "name", "cases", "top1", "top3", "mrr", "fault_acc"
    )
    return overall.unionByName(buckets).unionByName(faults)


def compare_modes(scores: DataFrame) -> DataFrame:
    """One row of rates per mode."""
    return scores.groupBy("mode").agg(*_rates())


def mode_coverage(cases: DataFrame, scores: DataFrame, modes=K.MODES) -> DataFrame:
    """Every case in every mode, scored or not."""
    facts = scores.select(*CASE_MODE, "predicted_service", "top1_hit", "top3_hit", "mrr", F.lit(True).alias("__s"))
    return (
        with_mode(cases.select("case_id"), modes)
        .join(facts, CASE_MODE, "left")
        .withColumn("scored", F.coalesce("__s", F.lit(False)))
        .drop("__s")
    )


def list_cases(cases: DataFrame, scores: DataFrame, artifacts: DataFrame, mode: str = "fusion") -> DataFrame:
    """Cases with their scores of one mode and whether an artifact exists."""
    facts = scores.filter(F.col("mode") == mode).select(
        "case_id", "top1_hit", "top3_hit", "mrr", "predicted_service", "confidence", "fault_match", "error_bucket",
        "engine_type", F.lit(True).alias("__s"),
    )
    stored = artifacts.filter(F.col("mode") == mode).select("case_id").distinct().withColumn("__a", F.lit(True))
    return (
        cases.join(facts, "case_id", "left")
        .join(stored, "case_id", "left")
        .withColumns({"scored": F.coalesce("__s", F.lit(False)), "has_artifact": F.coalesce("__a", F.lit(False))})
        .drop("__s", "__a")
    )


def file_inventory(cases: DataFrame, files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Presence and bytes of the four files, and the modes an artifact exists for."""
    sizes = files.filter(F.col("file_name").isin(*FILE_NAMES)).groupBy("case_id").agg(
        *[
            F.sum(F.when(F.col("file_name") == f, F.col("size_bytes"))).alias(f"{f.split('.')[0]}_bytes")
            for f in FILE_NAMES
        ]
    )
    modes = artifacts.groupBy("case_id").agg(F.sort_array(F.collect_set("mode")).alias("modes"))
    names = [f.split(".")[0] for f in FILE_NAMES]
    return (
        cases.join(sizes, "case_id", "left")
        .join(modes, "case_id", "left")
        .withColumns(
            {
                **{f"has_{n}_file": F.col(f"{n}_bytes").isNotNull() for n in names},
                **{f"{n}_bytes": F.coalesce(f"{n}_bytes", F.lit(0).cast("bigint")) for n in names},
                "modes": F.coalesce("modes", F.array().cast("array<string>")),
            }
        )
    )


def best_result(cases: DataFrame, artifacts: DataFrame, scores: DataFrame, modes=K.MODES) -> DataFrame:
    """Per (case, mode) the artifact's result, else the score row's, else none."""
    a = artifacts.select(*CASE_MODE, F.struct("predicted_service", "top1_hit", "mrr", "confidence").alias("__a"))
    s = scores.select(*CASE_MODE, F.struct("predicted_service", "top1_hit", "mrr", "confidence").alias("__s"))
    d = with_mode(cases.select("case_id"), modes).join(a, CASE_MODE, "left").join(s, CASE_MODE, "left")
    source = (
        F.when(F.col("__a").isNotNull(), F.lit("cache")).when(F.col("__s").isNotNull(), F.lit("csv_summary")).otherwise(F.lit("absent"))
    )
    return d.select(*CASE_MODE, source.alias("source"), F.coalesce("__a", "__s").alias("r")).select(
        *CASE_MODE, "source", (F.col("source") != "absent").alias("found"), (F.col("source") == "cache").alias("has_artifact"), "r.*"
    )


def comparison_table(scores: DataFrame, modes=K.MODES) -> DataFrame:
    """One row per case with prediction, hit, reciprocal rank and bucket of every mode side by side."""
    facts = F.struct("predicted_service", "top1_hit", "mrr", "error_bucket")
    wide = scores.groupBy("case_id", "ground_truth_service", "ground_truth_fault").pivot("mode", list(modes)).agg(F.first(facts))
    cells = []
    for m in modes:
        slug, cell = m.replace("-", "_"), F.col(f"`{m}`")
        cells += [
            cell["predicted_service"].alias(f"{slug}_pred"),
            cell["top1_hit"].alias(f"{slug}_top1"),
            cell["mrr"].alias(f"{slug}_mrr"),
            cell["error_bucket"].alias(f"{slug}_bucket"),
        ]
    return wide.select("case_id", "ground_truth_service", "ground_truth_fault", *cells)


def build_artifacts(reports: DataFrame, scores: DataFrame, contexts: DataFrame, debug: DataFrame, tokens: int = K.CONTEXT_TOKENS) -> DataFrame:
    """One nested row per (case, mode): summary counts, fusion view, context, report, evaluation."""
    r = reports.select(
        *CASE_MODE,
        F.struct(
            F.col("log_services"),
            F.col("snippets").alias("log_snippets"),
            "novel_templates",
            F.col("alerts").alias("metric_alerts"),
            "oom_alerts",
            F.col("traces").alias("trace_total"),
            F.col("spans").alias("trace_spans"),
            F.col("error_spans").alias("trace_errors"),
            F.col("bottlenecks").alias("trace_bottlenecks"),
        ).alias("summary_counts"),
        F.struct(
            "root_cause_service", "culprit_services", F.col("category").alias("failure_category"),
            F.col("confidence").alias("confidence_score"), F.col("summary").alias("root_cause_summary"),
            "primary_signal", "logs_insight", "metrics_insight", "traces_insight", "reasoning",
            "culprit_trace_id", "culprit_span_id",
            "remediation_action", "remediation_command", "remediation_impact",
        ).alias("report"),
    )
    c = contexts.select(
        *CASE_MODE,
        F.struct(
            F.lit(tokens).alias("max_tokens"), "total_tokens", "logs_tokens", "metric_tokens", "trace_tokens",
            F.col("context").alias("preview"),
        ).alias("prompt"),
    )
    g = debug.select(
        *CASE_MODE, F.struct("service_scores", "signal_votes", "category_likelihoods").alias("fusion")
    )
    e = scores.select(*CASE_MODE, F.struct(*[x for x in scores.columns if x not in CASE_MODE]).alias("evaluation"))
    return (
        r.join(c, CASE_MODE)
        .join(g, CASE_MODE)
        .join(e, CASE_MODE)
        .withColumns(
            {
                "schema_version": F.lit("1.0.0"),
                "engine_type": F.lit(K.LOCAL_ENGINE),
                "source": F.lit("live"),
                "created_at": F.current_timestamp(),
            }
        )
    )


def newest(results: DataFrame) -> DataFrame:
    """Latest row per (case, mode)."""
    order = Window.partitionBy(*CASE_MODE).orderBy(F.col("created_at").desc())
    return results.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
