"""Fusion of the three signals into a ranked list of suspects, a category and a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions.text import fixed
from faultlens.operators.windows import with_mode

CASE_MODE = ["case_id", "mode"]


def log_scores(kept: DataFrame) -> DataFrame:
    """(case, service, score, signal, ord) from the log evidence that the budget kept."""
    score = F.col("snippets") * K.WEIGHT_LOG_SNIPPET + F.least(F.col("novel_templates"), F.lit(K.NOVEL_CAP)) * K.WEIGHT_LOG_NOVEL
    return kept.select(
        "case_id", "service", score.cast("double").alias("score"), F.lit("LOGS").alias("signal"),
        F.struct(F.lit(0).alias("s"), F.col("budget_rank").cast("int").alias("r")).alias("ord"),
    )


def metric_scores(top: DataFrame) -> DataFrame:
    per_severity = (
        F.when(F.col("is_oom_risk"), F.lit(K.WEIGHT_METRIC_OOM))
        .when(F.col("severity") == "CRITICAL", F.lit(K.WEIGHT_METRIC_ALERT * 1.5))
        .when(F.col("severity") == "HIGH", F.lit(K.WEIGHT_METRIC_ALERT * 1.2))
        .when(F.col("severity") == "LOW", F.lit(K.WEIGHT_METRIC_ALERT * 0.5))
        .otherwise(F.lit(K.WEIGHT_METRIC_ALERT))
    )
    return top.groupBy("case_id", "service").agg(
        F.sum(per_severity).alias("score"),
        F.lit("METRICS").alias("signal"),
        F.struct(F.lit(1).alias("s"), F.min("alert_rank").cast("int").alias("r")).alias("ord"),
    )


def trace_scores(evidence: DataFrame) -> DataFrame:
    deep = F.when(F.col("leaf_depth") > 0, F.lit(K.WEIGHT_TRACE_DEPTH)).otherwise(F.lit(0.0))
    return evidence.filter(F.col("culprit_service").isNotNull()).select(
        "case_id", F.col("culprit_service").alias("service"), (F.lit(K.WEIGHT_TRACE_LEAF) + deep).alias("score"),
        F.lit("TRACES").alias("signal"),
        F.struct(F.lit(2).alias("s"), F.lit(0).alias("r")).alias("ord"),
    )


def with_modes(scores: DataFrame, modes=K.MODES) -> DataFrame:
    """Repeat each signal's evidence for the modes that may use it."""
    allowed = (
        (F.col("signal") == "LOGS")
        | ((F.col("signal") == "METRICS") & F.col("mode").isin(*K.MODES_WITH_METRICS))
        | ((F.col("signal") == "TRACES") & F.col("mode").isin(*K.MODES_WITH_TRACES))
    )
    return with_mode(scores, modes).filter(allowed)


def base_scores(signal_scores: DataFrame) -> DataFrame:
    """Sum per (case, mode, service) with the signals that voted and the first place of mention."""
    has = lambda s: F.bool_or(F.col("signal") == s)
    return signal_scores.groupBy(*CASE_MODE, "service").agg(
        F.sum("score").alias("base"),
        has("LOGS").alias("in_logs"),
        has("METRICS").alias("in_metrics"),
        has("TRACES").alias("in_traces"),
        F.min("ord").alias("ord"),
    )


def propagate(base: DataFrame, edges: DataFrame) -> DataFrame:
    """Shift blame from callers to scored callees.

    Callers act in the order of their first calls. A caller with scored callees keeps 60 % of what it has at its turn; each
    of those callees gains 2. So a service's score follows from how many of its callers act before and
    after its own turn. Edges only count in modes that see traces.
    """
    scored = base.select(*CASE_MODE, "service")
    # A service that never calls acts after all others.
    turns = edges.groupBy("case_id", "caller").agg(F.min("first_call").alias("turn"))
    edges = edges.drop("first_call").join(turns, ["case_id", "caller"])
    own = turns.select("case_id", F.col("caller").alias("callee"), F.col("turn").alias("callee_turn"))
    edges = edges.join(own, ["case_id", "callee"], "left")
    early = F.col("callee_turn").isNull() | (F.col("turn") < F.col("callee_turn"))
    live = (
        scored.filter(F.col("mode").isin(*K.MODES_WITH_TRACES))
        .withColumnRenamed("service", "caller")
        .join(edges, ["case_id", "caller"])
        .join(scored.withColumnRenamed("service", "callee"), [*CASE_MODE, "callee"], "left_semi")
    )
    damped = live.select(*CASE_MODE, F.col("caller").alias("service")).distinct().withColumn("damped", F.lit(True))
    boosts = live.groupBy(*CASE_MODE, F.col("callee").alias("service")).agg(
        F.count_if(early).alias("before"),
        F.count_if(~early).alias("after"),
    )
    joined = base.join(damped, [*CASE_MODE, "service"], "left").join(boosts, [*CASE_MODE, "service"], "left")
    before = F.coalesce("before", F.lit(0)) * K.CALLEE_BOOST
    after = F.coalesce("after", F.lit(0)) * K.CALLEE_BOOST
    score = F.when(F.col("damped"), (F.col("base") + before) * K.CALLER_DAMPING + after).otherwise(
        F.col("base") + before + after
    )
    return joined.withColumn("score", score).drop("damped", "before", "after")


def consensus(scores: DataFrame) -> DataFrame:
    """Reward services several signals agree on."""
    n = F.col("in_logs").cast("int") + F.col("in_metrics").cast("int") + F.col("in_traces").cast("int")
    factor = F.when(n == 2, F.lit(K.CONSENSUS_TWO)).when(n >= 3, F.lit(K.CONSENSUS_THREE)).otherwise(F.lit(1.0))
    return scores.withColumns({"signals": n, "score": F.col("score") * factor})


def rank_services(scores: DataFrame) -> DataFrame:
    """Rank per (case, mode); equal scores keep the order of first mention."""
    # Nine decimals: sums taken in another order must not part equal scores.
    order = Window.partitionBy(*CASE_MODE).orderBy(F.round("score", 9).desc(), "ord", "service")
    return scores.withColumn("rank", F.row_number().over(order))


def ranking(logs: DataFrame, top: DataFrame, traces: DataFrame, edges: DataFrame, modes=K.MODES) -> DataFrame:
    signal_scores = log_scores(logs).unionByName(metric_scores(top)).unionByName(trace_scores(traces))
    return rank_services(consensus(propagate(base_scores(with_modes(signal_scores, modes)), edges)))


def case_signals(cases: DataFrame, logs: DataFrame, metrics: DataFrame, top: DataFrame, traces: DataFrame, modes=K.MODES) -> DataFrame:
    """One row per (case, mode) with what each signal says as a whole; absent signals read as zero."""
    log_sums = logs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("log_services"),
        F.sum("snippets").alias("snippets"),
        F.sum("novel_templates").alias("novel_templates"),
        F.sum("infra_hits").alias("infra_hits"),
        F.sum("silent_hits").alias("silent_hits"),
        F.sum("tokens").alias("log_tokens"),
    )
    first = F.struct("service", "metric_name", "z", "is_oom_risk", "divergence")
    alert_sums = top.groupBy("case_id").agg(
        F.min_by(first, "alert_rank").alias("top_alert"),
        F.count(F.lit(1)).alias("alerts"),
        F.count_if("is_oom_risk").alias("oom_alerts"),
        F.count_if((F.col("time_to_oom") != 0) & (F.col("time_to_oom") < K.OOM_URGENT_SECONDS)).alias("urgent_oom"),
    )
    flags = metrics.select("case_id", "has_oom", "has_latency", F.lit(True).alias("metrics_seen"))
    spans = traces.select(
        "case_id", "traces", "spans", "error_spans", "bottlenecks", "leaf_depth", "culprit_service", "span_service",
        "span_operation", "span_status_code", "culprit_trace_id", "culprit_span_id",
    )
    joined = with_mode(cases.select("case_id"), modes)
    for part in (log_sums, alert_sums, flags, spans):
        joined = joined.join(part, "case_id", "left")
    use_m = F.col("mode").isin(*K.MODES_WITH_METRICS)
    use_t = F.col("mode").isin(*K.MODES_WITH_TRACES)
    count = lambda c, use=None: F.when(use if use is not None else F.lit(True), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    flag = lambda c: F.coalesce(use_m & F.col(c), F.lit(False))
    return joined.withColumns(
        {
            **{c: count(c) for c in ("log_services", "snippets", "novel_templates", "infra_hits", "silent_hits", "log_tokens")},
            **{c: count(c, use_m) for c in ("alerts", "oom_alerts", "urgent_oom")},
            **{c: count(c, use_t) for c in ("traces", "spans", "error_spans", "bottlenecks", "leaf_depth")},
            **{c: flag(c) for c in ("has_oom", "has_latency")},
            "top_alert": F.when(use_m, F.col("top_alert")),
            **{
                c: F.when(use_t, F.col(c))
                for c in ("culprit_service", "span_service", "span_operation", "span_status_code", "culprit_trace_id", "culprit_span_id")
            },
        }
    ).drop("metrics_seen")


def category_likelihoods(signals: DataFrame) -> DataFrame:
    """Six likelihoods per (case, mode) as columns ec1 … code_bug."""
    on = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    alerts, errors, narrow = F.col("alerts") > 0, F.col("error_spans"), F.col("bottlenecks") > 0
    oom = alerts & F.col("has_oom")
    cascade = (
        F.when(errors >= 2, 7.0 + F.least(F.lit(4.0), F.col("leaf_depth") * 1.5))
        .when(errors == 1, F.lit(3.0))
        .otherwise(F.lit(0.0))
    )
    logged = F.col("snippets") > 0
    hits = lambda c: F.when(logged, F.col(c) * 3.0).otherwise(F.lit(0.0))
    silent = ~logged & ~alerts & (errors == 0) & ~narrow
    return signals.withColumns(
        {
            "ec1": 0.1 + on(oom, 8.0) + on(oom & (F.col("urgent_oom") > 0), 4.0),
            "ec2": 0.1 + on(alerts & F.col("has_latency"), 6.5) + on((errors == 0) & narrow, 4.0),
            "ec3": 0.1 + cascade,
            "ec4": 0.05 + hits("silent_hits") + on(silent, 4.0),
            "ec5": 0.1 + hits("infra_hits"),
            "code_bug": 0.1
            + F.when(logged, 3.5 + F.least(F.lit(4.5), F.col("novel_templates") * 1.5)).otherwise(F.lit(0.0)),
        }
    )


LIKELIHOOD_COLUMNS = ("ec1", "ec2", "ec3", "ec4", "ec5", "code_bug")


def category(likelihoods: DataFrame) -> DataFrame:
    """Most likely category in declared order; unknown when nothing stands out."""
    best = F.greatest(*[F.col(c) for c in LIKELIHOOD_COLUMNS])
    pairs = list(zip(LIKELIHOOD_COLUMNS, K.CATEGORIES, strict=True))
    chosen = reduce(lambda acc, p: acc.when(F.col(p[0]) == best, F.lit(p[1])), pairs, F.when(best <= 0.2, F.lit(K.UNKNOWN_CATEGORY)))
    return likelihoods.withColumn("category", chosen)


def with_ranking(signals: DataFrame, ranked: DataFrame) -> DataFrame:
    """Attach the ranked services, best first, and the facts of the best one."""
    lists = ranked.groupBy(*CASE_MODE).agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "service", "score", "in_logs", "in_metrics", "in_traces"))
        ).alias("ranked")
    )
    out = signals.join(lists, CASE_MODE, "left")
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return out.withColumns(
        {
            "top_service": F.coalesce(first["service"], F.lit("unknown")),
            "top_score": first["score"],
            "runner_score": second["score"],
            "top_in_logs": F.coalesce(first["in_logs"], F.lit(False)),
            "top_in_metrics": F.coalesce(first["in_metrics"], F.lit(False)),
            "top_in_traces": F.coalesce(first["in_traces"], F.lit(False)),
        }
    )


def confidence(df: DataFrame) -> DataFrame:
    """Agreement of the signals behind the best service, scaled by its lead over the next one."""
    c_m = F.when(
        F.col("alerts") > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.40), F.col("top_alert")["divergence"] / 8.0))
    ).otherwise(F.lit(0.0))
    traced = (F.col("error_spans") > 0) | (F.col("bottlenecks") > 0)
    c_t = F.when(
        traced, F.least(F.lit(0.95), F.greatest(F.lit(0.50), 0.45 + 0.15 * F.col("leaf_depth")))
    ).otherwise(F.lit(0.0))
    c_l = F.when(
        F.col("snippets") > 0,
        F.least(F.lit(0.90), F.greatest(F.lit(0.35), 0.35 + 0.10 * F.least(F.lit(5), F.col("snippets")))),
    ).otherwise(F.lit(0.0))
    parts = {"top_in_metrics": c_m, "top_in_traces": c_t, "top_in_logs": c_l}
    agreeing = sum(((F.col(k) & (c > 0)).cast("int") for k, c in parts.items()), F.lit(0))
    doubt = reduce(
        lambda acc, kc: acc * F.when(F.col(kc[0]) & (kc[1] > 0), 1.0 - kc[1]).otherwise(F.lit(1.0)),
        parts.items(),
        F.lit(1.0),
    )
    lead = (F.col("top_score") - F.col("runner_score")) / F.nullif(F.col("top_score"), F.lit(0.0))
    margin = (
        F.when(F.col("runner_score").isNull(), F.lit(1.0))
        .when(F.col("top_score") > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.0), lead)))
        .otherwise(F.lit(0.2))
    )
    support = df.withColumns({"agreeing": agreeing, "support": 1.0 - doubt, "margin": margin})
    calibrated = F.col("support") * (0.65 + 0.35 * F.col("margin"))
    bounded = F.greatest(F.lit(0.50), F.least(F.lit(0.95), F.round(calibrated, 2)))
    return support.withColumn("confidence", F.when(F.col("agreeing") > 0, bounded).otherwise(F.lit(0.50)))


def primary_signal(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "primary_signal",
        F.when(F.col("agreeing") >= 2, F.lit("FUSION"))
        .when(F.col("top_in_traces"), F.lit("TRACES"))
        .when(F.col("top_in_metrics"), F.lit("METRICS"))
        .when(F.col("top_in_logs"), F.lit("LOGS"))
        .otherwise(F.lit("FUSION")),
    )


def told(sentence: str, *values: Column) -> Column:
    """A sentence of the report with its values filled in."""
    first, *rest = K.REPORT[sentence].split("{}")
    return F.concat(F.lit(first), *[x for v, part in zip(values, rest, strict=True) for x in (v.cast("string"), F.lit(part))])


def triangulation(df: DataFrame, logs: DataFrame, top: DataFrame) -> DataFrame:
    """What each signal says about the best service, in words."""
    own_logs = logs.select("case_id", F.col("service").alias("top_service"), F.col("snippets").alias("__s"), F.col("novel_templates").alias("__n"))
    own_alert = top.groupBy("case_id", F.col("service").alias("top_service")).agg(
        F.count(F.lit(1)).alias("__a"),
        F.min_by(F.struct("metric_name", "z", "is_oom_risk"), "alert_rank").alias("__m"),
    )
    d = df.join(own_logs, ["case_id", "top_service"], "left").join(own_alert, ["case_id", "top_service"], "left")
    logs_insight = (
        F.when(F.col("log_services") == 0, told("no_logs"))
        .when(F.col("__s") > 0, told("own_logs", F.col("__s"), F.col("top_service"), F.col("__n")))
        .otherwise(told("other_logs", F.col("snippets"), F.col("log_services")))
    )
    risk = F.when(F.col("__m")["is_oom_risk"], told("oom_risk")).otherwise(F.lit(""))
    peak, own = F.col("top_alert"), F.col("__m")
    metrics_insight = (
        F.when(F.col("alerts") == 0, told("no_alerts"))
        .when(F.col("__a") > 0, told("own_alerts", F.col("__a"), F.col("top_service"), own["metric_name"], fixed(own["z"], 2, True), risk))
        .otherwise(told("other_alerts", peak["service"], peak["metric_name"], fixed(peak["z"], 2, True)))
    )
    status = F.coalesce(F.nullif("span_status_code", F.lit(0)).cast("string"), F.lit("ERROR"))
    traces_insight = (
        F.when(F.col("error_spans") == 0, told("no_errors"))
        .when(F.col("span_service").isNotNull(), told("leaf", F.col("span_service"), F.col("span_operation"), F.col("leaf_depth"), status))
        .otherwise(told("errors", F.col("error_spans")))
    )
    named = d.withColumns({"logs_insight": logs_insight, "metrics_insight": metrics_insight, "traces_insight": traces_insight})
    reasoning = F.concat_ws(
        " ",
        told("localized", F.col("top_service"), F.col("category")),
        told("agreement", F.col("agreeing"), F.col("primary_signal")),
        F.when(F.col("traces_insight").contains("deepest leaf"), told("downstream")),
        F.when(F.col("metrics_insight").contains("OOM risk"), told("climbing")),
    )
    return named.withColumn("reasoning", reasoning).drop("__s", "__n", "__a", "__m")


def rca_report(df: DataFrame) -> DataFrame:
    """Final report: three culprits at most, category, confidence, summary and one default remedy."""
    services = F.transform("ranked", lambda r: r["service"])
    top = F.col("top_service")
    return df.withColumns(
        {
            "root_cause_service": top,
            "culprit_services": F.coalesce(F.slice(services, 1, 3), F.array(top)),
            "summary": told("summary", top, F.col("category")),
            "remediation_action": told("action", top),
            "remediation_command": told("command", top),
            "remediation_impact": told("impact", top),
        }
    )


def fusion_debug(df: DataFrame) -> DataFrame:
    """Per (case, mode): service scores, votes per signal and likelihoods, rounded to four digits."""
    votes = lambda flag: F.array_sort(
        F.transform(F.filter("ranked", lambda r: r[flag]), lambda r: r["service"])
    )
    empty = F.array().cast("array<struct<rank:int,service:string,score:double,in_logs:boolean,in_metrics:boolean,in_traces:boolean>>")
    d = df.withColumn("ranked", F.coalesce("ranked", empty))
    pairs = [x for c, n in zip(LIKELIHOOD_COLUMNS, K.CATEGORIES, strict=True) for x in (F.lit(n), F.round(c, 4))]
    return d.select(
        *CASE_MODE,
        F.map_from_entries(F.transform("ranked", lambda r: F.struct(r["service"], F.round(r["score"], 4)))).alias("service_scores"),
        F.create_map(
            F.lit("LOGS"), votes("in_logs"), F.lit("METRICS"), votes("in_metrics"), F.lit("TRACES"), votes("in_traces")
        ).alias("signal_votes"),
        F.create_map(*pairs).alias("category_likelihoods"),
        "category",
        "confidence",
    )
