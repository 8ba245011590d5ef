"""Data-quality checks; each gives rows (case_id, name, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions import naming, text
from faultlens.functions.text import fixed


def _rows(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.select("case_id", F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"))


def phase_order(logs: DataFrame, points: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """Baseline strictly before the injection, incident not before it, per signal with both sides."""
    both = (
        logs.select("case_id", "phase", "ts", F.lit("logs").alias("signal"))
        .unionByName(points.select("case_id", "phase", "ts", F.lit("metrics").alias("signal")))
        .unionByName(spans.select("case_id", "phase", (F.col("start_us") / 1e6).alias("ts"), F.lit("traces").alias("signal")))
    )
    edges = (
        both.groupBy("case_id", "signal")
        .agg(
            F.max(F.when(F.col("phase") == "baseline", F.col("ts"))).alias("last_base"),
            F.min(F.when(F.col("phase") == "incident", F.col("ts"))).alias("first_inc"),
        )
        .filter(F.col("last_base").isNotNull() & F.col("first_inc").isNotNull())
        .join(cases.select("case_id", "inject_time"), "case_id")
    )
    ok = (F.col("last_base") < F.col("inject_time")) & (F.col("inject_time") <= F.col("first_inc"))
    detail = F.concat(F.lit("max_base="), fixed(F.col("last_base"), 3), F.lit(" min_inc="), fixed(F.col("first_inc"), 3))
    return edges.select(
        "case_id", F.concat("signal", F.lit(" baseline strictly before injection")).alias("name"), ok.alias("ok"), detail.alias("detail")
    )


def trace_shape(links: DataFrame) -> DataFrame:
    """No orphaned spans; how many traces have exactly one root; at least one trace."""
    per_trace = links.groupBy("case_id", "trace_id").agg(
        F.count_if(F.col("parent_id").isNotNull() & ~F.col("has_parent")).alias("orphans"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count(F.lit(1)).alias("n"),
    )
    per_case = per_trace.groupBy("case_id").agg(
        F.sum("orphans").alias("orphans"),
        F.sum("n").alias("spans"),
        F.count_if(F.col("roots") == 1).alias("whole"),
        F.count(F.lit(1)).alias("traces"),
    )
    detail = F.concat(
        F.col("orphans"), F.lit("/"), F.col("spans"), F.lit(" orphaned, "), F.col("whole"), F.lit("/"), F.col("traces"),
        F.lit(" traces have exactly one root"),
    )
    some = F.concat(F.col("traces"), F.lit(" traces / "), F.col("spans"), F.lit(" spans"))
    return _rows(per_case, "trace DAG has no orphaned spans", F.col("orphans") == 0, detail).unionByName(
        _rows(per_case, "at least one incident trace", F.col("traces") > 0, some)
    )


def service_overlap(spans: DataFrame, points: DataFrame, logs: DataFrame) -> DataFrame:
    """Trace services that metrics or logs also name, and those they do not."""
    traced = spans.select("case_id", "service").distinct()
    other = (
        points.select("case_id", naming.metric_service(F.col("metric_name"), F.col("query")).alias("service"))
        .union(logs.select("case_id", "service"))
        .distinct()
    )
    shared = traced.intersect(other).groupBy("case_id").agg(F.count(F.lit(1)).alias("shared"))
    alone = traced.exceptAll(other).groupBy("case_id").agg(F.sort_array(F.collect_set("service")).alias("alone"))
    d = traced.select("case_id").distinct().join(shared, "case_id", "left").join(alone, "case_id", "left")
    detail = F.concat(F.lit("trace_only="), F.coalesce(F.array_join("alone", ","), F.lit("")))
    return _rows(d, "trace services overlap metric/log service names", F.coalesce("shared", F.lit(0)) > 0, detail)


def z_reproducible(alerts: DataFrame) -> DataFrame:
    """z of every alert with a spread follows from its stored stats to 1e-6."""
    again = (F.col("peak") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    bad = F.coalesce(F.abs(again - F.col("z")) > 1e-6, F.lit(False))
    d = alerts.groupBy("case_id").agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    return _rows(
        d, "metric z-scores reproducible from stored stats", F.col("bad") == 0,
        F.concat(F.col("bad"), F.lit(" of "), F.col("n"), F.lit(" alerts mismatch")),
    )


def context_rules(contexts: DataFrame, reports: DataFrame) -> DataFrame:
    """Opaque id, no case id in the text, token count as recounted and under budget, sane report."""
    d = contexts.join(reports.select("case_id", "mode", "ranked", "confidence"), ["case_id", "mode"])
    first = F.split_part("context", F.lit("\n"), F.lit(1))
    rules = {
        "context incident id is opaque": first.contains("INC-") & ~first.contains(F.col("case_id")),
        "case id does not appear in the context": ~F.col("context").contains(F.col("case_id")),
        "context token accounting holds": F.col("total_tokens") == text.est_tokens(F.col("context"), 3),
        "context under 2500 tokens": F.col("total_tokens") < 2500,
        "ranked candidates are non-empty": F.coalesce(F.size("ranked"), F.lit(0)) > 0,
        "confidence within [0, 1]": F.col("confidence").between(0, 1),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ok.alias("ok")) for n, ok in rules.items()]))
    return d.select("case_id", "mode", "total_tokens", each.alias("r")).select(
        "case_id", F.concat("mode", F.lit(": "), F.col("r.name")).alias("name"), F.col("r.ok").alias("ok"),
        F.concat(F.col("total_tokens"), F.lit(" tokens")).alias("detail"),
    )


def artifacts_match(artifacts: DataFrame, scores: DataFrame) -> DataFrame:
    """Every artifact has a score row and agrees with it; its context does not leak the case id."""
    s = scores.select("case_id", "mode", F.struct("top1_hit", "top3_hit", "mrr").alias("s"))
    a = artifacts.select("case_id", "mode", F.struct("top1_hit", "top3_hit", "mrr").alias("a"), "context")
    d = a.join(s, ["case_id", "mode"], "left")
    same = (
        (F.col("a.top1_hit") == F.col("s.top1_hit"))
        & (F.col("a.top3_hit") == F.col("s.top3_hit"))
        & (F.abs(F.col("a.mrr") - F.col("s.mrr")) <= 1e-6)
    )
    per_case = d.groupBy("case_id").agg(
        F.count_if(F.col("s").isNotNull() & ~same).alias("wrong"),
        F.count_if(F.col("s").isNull()).alias("missing"),
        F.count_if(F.col("context").contains(F.col("case_id"))).alias("leaks"),
        F.count(F.lit(1)).alias("n"),
    )
    of = lambda c: F.concat(F.col(c), F.lit(" of "), F.col("n"))
    return (
        _rows(per_case, "artifact evaluation matches score row", F.col("wrong") == 0, of("wrong"))
        .unionByName(_rows(per_case, "every artifact has a score row", F.col("missing") == 0, of("missing")))
        .unionByName(_rows(per_case, "no artifact context leaks the case id", F.col("leaks") == 0, of("leaks")))
    )


