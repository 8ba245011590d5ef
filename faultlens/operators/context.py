"""Context text per (case, mode) under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import naming, text
from faultlens.operators.windows import with_mode


def effective(tokens: int) -> int:
    """Tokens of a context that its own text may take."""
    return max(400, tokens - K.CONTEXT_OVERHEAD)


def elastic(tokens: int) -> int:
    """Tokens that the sections share."""
    return max(300, effective(tokens) - K.FIXED_OVERHEAD)


def topology_text(edges: DataFrame) -> DataFrame:
    """Caller → callees lines of each case, in caller order."""
    lists = edges.groupBy("case_id", "caller").agg(F.array_join(F.sort_array(F.collect_set("callee")), ", ").alias("c"))
    line = F.concat(F.lit("- "), F.col("caller"), F.lit(" ➔ ["), F.col("c"), F.lit("]"))
    return lists.groupBy("case_id").agg(
        F.concat(
            F.lit("### Service Dependency Graph (Caller -> Callees):\n"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("caller", line.alias("line")))), lambda x: x["line"]), "\n"
            ),
        ).alias("topology")
    )


def log_text(kept: DataFrame) -> DataFrame:
    """Texts of the kept services, most snippets first."""
    order = F.struct((-F.col("snippets")).alias("a"), F.col("budget_rank").alias("b"), F.col("text").alias("t"))
    return kept.groupBy("case_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), "\n\n").alias("log_text")
    )


def budget_sections(
    cases: DataFrame,
    kept_logs: DataFrame,
    metrics: DataFrame,
    traces: DataFrame,
    edges: DataFrame,
    modes=K.MODES,
    tokens: int = K.CONTEXT_TOKENS,
) -> DataFrame:
    """Sections of every (case, mode) cut to their shares: traces, then metrics, logs take the rest.

    `traces` carries `text` (its readable beginning) and `text_chars` (its whole length).
    """
    d = with_mode(cases.select("case_id"), modes)
    d = d.join(traces.select("case_id", F.col("text").alias("t"), F.col("text_chars").alias("tc")), "case_id", "left")
    d = d.join(topology_text(edges), "case_id", "left")
    d = d.join(metrics.select("case_id", F.col("text").alias("m")), "case_id", "left")
    d = d.join(log_text(kept_logs), "case_id", "left")
    use_t, use_m = F.col("mode").isin(*K.MODES_WITH_TRACES), F.col("mode").isin(*K.MODES_WITH_METRICS)

    trace_all = F.concat_ws("\n\n", "topology", "t")
    trace_chars = (
        F.coalesce(F.length("topology"), F.lit(0))
        + F.coalesce(F.col("tc"), F.lit(0))
        + F.when(F.col("topology").isNotNull() & F.col("t").isNotNull(), 2).otherwise(0)
    )
    trace_cap = F.greatest(
        F.lit(K.TRACE_MIN), F.least(text.tokens_for_length(trace_chars, 3), F.lit(int(elastic(tokens) * K.TRACE_SHARE)))
    )
    metric_cap = F.greatest(
        F.lit(K.METRIC_MIN), F.least(text.est_tokens(F.col("m"), 3), F.lit(int(elastic(tokens) * K.METRIC_SHARE)))
    )
    d = d.withColumns(
        {
            "header": F.concat(F.lit("### Incident Reference ID: "), naming.incident_id(F.col("case_id"))),
            "trace_section": F.when(use_t & F.col("t").isNotNull(), text.truncate_tokens(trace_all, trace_cap, trace_chars)),
            "metric_section": F.when(use_m & F.col("m").isNotNull(), text.truncate_tokens(F.col("m"), metric_cap)),
        }
    )
    used = text.est_tokens(F.concat_ws("\n\n", "header", "trace_section", "metric_section"), 3)
    room = F.greatest(F.lit(K.LOG_MIN), F.lit(effective(tokens)) - used - F.lit(K.LOG_SLACK))
    log_section = F.concat(F.lit(K.LOG_SECTION_TITLE), text.truncate_tokens(F.col("log_text"), room))
    return d.withColumn("log_section", log_section).select(
        "case_id", "mode", "header", "trace_section", "metric_section", "log_section"
    )


def build_context(sections: DataFrame, budget: int = K.CONTEXT_TOKENS) -> DataFrame:
    """Final text and the tokens of every section; the whole is clamped to the budget."""
    whole = F.concat_ws("\n\n", "header", "trace_section", "metric_section", "log_section", F.lit(K.CONTEXT_CLOSING))
    tokens = lambda c: F.coalesce(text.est_tokens(F.col(c), 3), F.lit(0).cast("bigint"))
    return (
        sections.withColumn("context", text.truncate_tokens(whole, F.lit(effective(budget))))
        .withColumns(
            {
                "trace_tokens": tokens("trace_section"),
                "metric_tokens": tokens("metric_section"),
                "logs_tokens": tokens("log_section"),
                "total_tokens": text.est_tokens(F.col("context"), 3),
            }
        )
        .select("case_id", "mode", "context", "trace_tokens", "metric_tokens", "logs_tokens", "total_tokens")
    )
