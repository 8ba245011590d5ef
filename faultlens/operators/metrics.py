"""Metric evidence: baselines, divergence, slopes, memory risk, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import naming
from faultlens.functions.text import fixed
from faultlens.plans.materialize import materialize
from faultlens.plans.ordering import numbered
from faultlens.plans.quantile import exact_median

METRIC = ["case_id", "metric_name"]


def mean_std(value: str = "value") -> dict[str, Column]:
    """Sample mean and deviation; a single point deviates by zero."""
    return {"mean": F.avg(value), "std": F.coalesce(F.stddev_samp(value), F.lit(0.0))}


def series_stats(points: DataFrame) -> DataFrame:
    """n, mean, std, median and MAD of every series in `points`.

    The values are read four times (sketch and ranks, around zero and around the median), so they are
    written once, in three columns; the centre, one row per series, likewise.
    """
    values = materialize(points.select(*METRIC, "value"), "series")
    center = materialize(exact_median(values, METRIC, "value", "median", extra=mean_std()), "series-centre")
    spread = (
        values.join(center.select(*METRIC, "median"), METRIC)
        .select(*METRIC, F.abs(F.col("value") - F.col("median")).alias("deviation"))
    )
    mad = exact_median(spread, METRIC, "deviation", "mad").drop("n")
    return center.join(mad, METRIC)


def baseline_stats(points: DataFrame) -> DataFrame:
    return series_stats(points.filter(F.col("phase") == "baseline"))


def self_baseline_points(points: DataFrame) -> DataFrame:
    """First 30 % (at least two) of the incident points of series that have no baseline."""
    with_baseline = points.filter(F.col("phase") == "baseline").select(*METRIC).distinct()
    bare = points.filter(F.col("phase") == "incident").join(with_baseline, METRIC, "left_anti")
    sizes = bare.groupBy(*METRIC).agg(F.count(F.lit(1)).alias("__n"))
    head = F.greatest(F.lit(2), F.floor(F.col("__n") * F.lit(K.SELF_BASELINE_SHARE)))
    return (
        numbered(bare, METRIC, ["ts", "seq"], F.floor("ts"), "__i")
        .join(sizes, METRIC)
        .filter(F.col("__i") < head)
        .select(*points.columns)
    )


def self_baseline(points: DataFrame) -> DataFrame:
    return series_stats(self_baseline_points(points))


def reference_stats(points: DataFrame) -> DataFrame:
    """Stats every incident series is judged by: one pass over baseline and self-baseline points."""
    basis = points.filter(F.col("phase") == "baseline").unionByName(self_baseline_points(points))
    return series_stats(basis)


def memory_limits(points: DataFrame) -> DataFrame:
    """Limit per service: last value of its limit series; baseline series come first, later ones win."""
    limits = points.filter(naming.metric_kind(F.col("metric_name"))["limit"])
    last = limits.groupBy(*METRIC, "query", "phase").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    rank = F.struct((F.col("phase") == "incident"), F.col("metric_name"), F.col("query"))
    return (
        last.filter(F.col("value") > 0)
        .groupBy("case_id", naming.metric_service(F.col("metric_name"), F.col("query")).alias("service"))
        .agg(F.max_by("value", rank).alias("memory_limit"))
    )


def slope(points: DataFrame) -> DataFrame:
    """Least-squares change per second of each incident series; zero when it cannot be told."""
    origin = points.groupBy(*METRIC).agg(F.avg("ts").alias("__t0"))
    centred = points.join(origin, METRIC).withColumn("__t", F.col("ts") - F.col("__t0"))
    fit = F.regr_slope(F.col("value"), F.col("__t"))
    return centred.groupBy(*METRIC).agg(
        F.when((F.count(F.lit(1)) < 2) | (F.max("ts") <= F.min("ts")), F.lit(0.0))
        .otherwise(F.coalesce(fit, F.lit(0.0)))
        .alias("slope")
    )


def peak(incident: DataFrame, stats: DataFrame) -> DataFrame:
    """Value farthest from the reference mean, first on a tie."""
    away = F.abs(F.col("value") - F.col("mean"))
    return (
        incident.join(stats, METRIC)
        .groupBy(*METRIC)
        .agg(F.min_by("value", F.struct(-away, F.col("ts"), F.col("seq"))).alias("peak"))
    )


def z_scores(df: DataFrame) -> DataFrame:
    """z and robust z of `peak`, with a floor under both spreads."""
    floor = F.when(F.col("mean") != 0, F.greatest(F.lit(1e-6), F.abs("mean") * 1e-4)).otherwise(F.lit(1e-4))
    return df.withColumns(
        {
            "z": (F.col("peak") - F.col("mean")) / F.greatest(F.col("std"), floor),
            "robust_z": F.lit(K.ROBUST_FACTOR) * (F.col("peak") - F.col("median")) / F.greatest(F.col("mad"), floor),
        }
    ).withColumn("divergence", F.greatest(F.abs("z"), F.abs("robust_z")))


def adaptive_tau(mean: Column, std: Column, default: float = K.Z_THRESHOLD) -> Column:
    flat = (mean == 0) | (std == 0)
    variation = F.abs(std / F.nullif(mean, F.lit(0.0)))
    scaled = F.lit(default) * (1.0 + 0.25 * F.least(F.lit(2.0), variation))
    return F.when(flat, F.lit(default)).otherwise(F.greatest(F.lit(2.5), F.least(F.lit(5.0), scaled)))


def oom_risk(df: DataFrame, slope_limit: float = K.OOM_SLOPE_BYTES_PER_SECOND) -> DataFrame:
    """Time to the memory limit and the risk flag; needs slope, memory_limit, peak, mean, z, robust_z."""
    rising = F.col("is_memory") & (F.col("slope") > 0)
    left = F.greatest(F.lit(0.0), F.col("memory_limit") - F.col("peak"))
    tto = F.when(rising & (F.col("memory_limit") != 0), left / F.nullif(F.col("slope"), F.lit(0.0)))
    dynamic = F.greatest(
        F.lit(K.OOM_SLOPE_FLOOR),
        F.when(F.col("mean") > 0, F.least(F.lit(slope_limit), F.abs("mean") * 0.05)).otherwise(F.lit(slope_limit)),
    )
    steep = F.col("is_memory") & (F.col("slope") > dynamic) & ((F.col("z") > 1.5) | (F.col("robust_z") > 1.5))
    return df.withColumn("time_to_oom", tto).withColumn(
        "is_oom_risk", F.coalesce(F.col("time_to_oom") < K.OOM_HORIZON_SECONDS, F.lit(False)) | F.coalesce(steep, F.lit(False))
    )


def evaluate(
    points: DataFrame, z_threshold: float = K.Z_THRESHOLD, slope_limit: float = K.OOM_SLOPE_BYTES_PER_SECOND
) -> DataFrame:
    """Every incident series with all its numbers, before the alert rule."""
    incident = points.filter(F.col("phase") == "incident")
    stats = reference_stats(points)
    away = F.abs(F.col("value") - F.col("mean"))
    judged = (
        incident.join(stats, METRIC)
        .groupBy(*METRIC, "mean", "std", "median", "mad")
        .agg(
            F.max("query").alias("query"),
            F.min_by("value", F.struct(-away, F.col("ts"), F.col("seq"))).alias("peak"),
        )
    )
    memory = naming.metric_kind(F.col("metric_name"))["memory"]
    slopes = slope(incident.filter(memory))
    kind = naming.metric_kind(F.col("metric_name"))
    named = judged.withColumns(
        {
            "service": naming.metric_service(F.col("metric_name"), F.col("query")),
            "is_memory": kind["memory"],
            "is_latency": kind["latency"],
        }
    )
    full = named.join(slopes, METRIC, "left").join(memory_limits(points), ["case_id", "service"], "left")
    return oom_risk(z_scores(full), slope_limit).withColumn("tau", adaptive_tau(F.col("mean"), F.col("std"), z_threshold))


def alerts(evaluated: DataFrame) -> DataFrame:
    """Series that exceed their threshold or risk running out of memory, with severity."""
    d, tau = F.col("divergence"), F.col("tau")
    severity = (
        F.when(F.col("is_oom_risk") | (d >= tau * 2.5), F.lit("CRITICAL"))
        .when(d >= tau * 1.6, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )
    late = F.col("is_latency") & ((F.col("z") > tau) | (F.col("robust_z") > tau))
    return (
        evaluated.filter((d >= tau) | F.col("is_oom_risk"))
        .withColumns({"severity": severity, "latency_anomaly": late})
        .withColumn("severity_rank", F.array_position(F.array(*[F.lit(s) for s in K.SEVERITIES]), F.col("severity")))
    )


def top_alerts(found: DataFrame, limit: int = K.MAX_ALERTS) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy("severity_rank", F.col("divergence").desc(), "metric_name")
    return found.withColumn("alert_rank", F.row_number().over(order)).filter(F.col("alert_rank") <= limit)


def alert_text(df: DataFrame) -> DataFrame:
    """Description and list line of every alert."""
    mb = lambda plus: fixed(F.col("slope") / 1e6, 2, plus)
    spike = F.concat(
        F.lit("Spike to "), fixed(F.col("peak"), 2), F.lit(" (baseline μ="), fixed(F.col("mean"), 2),
        F.lit(", σ="), fixed(F.col("std"), 2), F.lit(", z="), fixed(F.col("z"), 2, True),
        F.lit(", robust_z="), fixed(F.col("robust_z"), 2, True), F.lit(", τ="), fixed(F.col("tau"), 2), F.lit(")"),
    )
    tto = fixed(F.col("time_to_oom"), 0)
    risk = F.concat(
        F.lit("; Steep memory slope +"), mb(False), F.lit("MB/s indicates OOM risk"),
        F.coalesce(F.concat(F.lit(" (estimated TimeToOOM: "), tto, F.lit("s)")), F.lit("")),
    )
    rising = F.concat(F.lit("; Slope +"), mb(False), F.lit("MB/s"))
    more = F.when(F.col("is_oom_risk"), risk).when(F.col("slope") > 0, rising).otherwise(F.lit(""))
    item = F.concat(
        F.lit("- ["), F.col("severity"), F.lit("] Service '"), F.col("service"), F.lit("' - "), F.col("metric_name"),
        F.lit(": value="), fixed(F.col("peak"), 2), F.lit(" (baseline μ="), fixed(F.col("mean"), 2),
        F.lit(", z="), fixed(F.col("z"), 2, True),
        F.when(F.col("slope") != 0, F.concat(F.lit(", slope="), mb(True), F.lit("MB/s"))).otherwise(F.lit("")),
        F.lit(")"),
        F.when(F.col("is_oom_risk"), F.lit(" [CRITICAL OOM RISK]")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" (TimeToOOM ~"), tto, F.lit("s)")), F.lit("")),
    )
    return df.withColumns({"description": F.concat(spike, more), "item": item})


def metric_evidence(evaluated: DataFrame, found: DataFrame, top: DataFrame) -> DataFrame:
    """Per case: series evaluated, flags over all alerts, and the text of the top alerts."""
    counts = evaluated.groupBy("case_id").agg(F.count(F.lit(1)).alias("metrics_evaluated"))
    flags = found.groupBy("case_id").agg(
        F.bool_or("is_oom_risk").alias("has_oom"), F.bool_or("latency_anomaly").alias("has_latency")
    )
    lines = top.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("alert_rank", "item"))), lambda x: x["item"]), "\n"
        ).alias("__lines"),
    )
    silent = F.lit("No metric anomalies detected (Z-scores within normal distribution).")
    return (
        counts.join(flags, "case_id", "left")
        .join(lines, "case_id", "left")
        .select(
            "case_id",
            "metrics_evaluated",
            F.coalesce("alerts", F.lit(0).cast("bigint")).alias("alerts"),
            F.coalesce("has_oom", F.lit(False)).alias("has_oom"),
            F.coalesce("has_latency", F.lit(False)).alias("has_latency"),
            F.coalesce(F.concat(F.lit("### Metric Anomaly Alerts:\n"), F.col("__lines")), silent).alias("text"),
        )
    )
