"""Trace evidence: span links, depth, self time, culprits, call trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import spans as S
from faultlens.functions.text import fixed
from faultlens.plans.materialize import materialize
from faultlens.plans.quantile import exact_ranks

TRACE = ["case_id", "trace_id"]
SPAN = ["case_id", "trace_id", "span_id"]


def with_error_facts(spans: DataFrame) -> DataFrame:
    """Error facts as plain columns; tags and logs are not needed afterwards."""
    facts = S.span_error(F.col("tags"), F.col("logs"))
    return (
        spans.withColumn("__e", facts)
        .withColumns(
            {
                "is_error": F.col("__e")["is_error"],
                "is_timeout": S.is_timeout(F.col("__e")),
                "status_code": F.col("__e")["status_code"],
                "error_code": F.col("__e")["error_code"],
                "error_message": F.col("__e")["error_message"],
            }
        )
        .drop("__e", "tags", "logs")
    )


def last_per_id(spans: DataFrame, *columns: str) -> DataFrame:
    """One row per span id; of repeated ids the last row counts."""
    return spans.groupBy(*SPAN).agg(F.max_by(F.struct(*columns), "seq").alias("__s")).select(*SPAN, "__s.*")


def link_spans(spans: DataFrame) -> DataFrame:
    """Resolve each span's parent inside its trace. Needs the columns of `with_error_facts`."""
    parents = last_per_id(
        spans.select(*SPAN, "seq", "service", "duration_us", "is_timeout", F.col("seq").alias("s")),
        "service", "duration_us", "is_timeout", "s",
    ).select(
        *TRACE,
        F.col("span_id").alias("parent_id"),
        F.col("service").alias("parent_service"),
        F.col("duration_us").alias("parent_duration_us"),
        F.col("is_timeout").alias("parent_timeout"),
        F.col("s").alias("parent_seq"),
    )
    return spans.join(parents, [*TRACE, "parent_id"], "left").withColumn(
        "has_parent", F.col("parent_seq").isNotNull()
    )


def service_edges(links: DataFrame) -> DataFrame:
    known = lambda c: (F.col(c) != "") & (F.col(c) != K.UNKNOWN_SERVICE)
    return (
        links.filter(
            F.col("has_parent") & (F.col("parent_service") != F.col("service")) & known("parent_service") & known("service")
        )
        .groupBy("case_id", F.col("parent_service").alias("caller"), F.col("service").alias("callee"))
        .agg(F.min(F.struct("trace_start_us", "trace_id", "seq")).alias("first_call"))
    )


def callee_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("case_id", "caller").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def mark_roots(links: DataFrame) -> DataFrame:
    """Add `is_root`: no parent inside the trace, or the first span of a trace that has no such span.

    Links are written once, and so are the traces without a root, which are few as a rule: Spark then knows their size
    and does not shuffle the links for them.
    """
    links = materialize(links, "links")
    rootless = (
        links.groupBy(*TRACE)
        .agg(F.bool_or(~F.col("has_parent")).alias("any_root"), F.min("seq").alias("first_seq"))
        .filter(~F.col("any_root"))
        .select(*TRACE, "first_seq")
    )
    return links.join(materialize(rootless, "rootless"), TRACE, "left").withColumn(
        "is_root", ~F.col("has_parent") | F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    ).drop("first_seq")


def roots(links: DataFrame) -> DataFrame:
    return mark_roots(links).filter("is_root")


def span_depth(marked: DataFrame, with_path: bool = False) -> DataFrame:
    """Depth of every span below its root, by pointer doubling.

    Each round replaces a span's pointer by its target's pointer, so a chain of length d takes log2(d)
    rounds. A round is one equality join of the spans still on their way; only those are written again.
    Spans that no root reaches (a cycle beside a root) keep depth 0. With `path`, the ordinals from root
    to span are kept.
    """
    node = last_per_id(
        marked.select(*SPAN, "seq", "is_root", "parent_id", F.col("seq").alias("s")), "is_root", "parent_id", "s"
    )
    columns = {
        "up": F.when(~F.col("is_root"), F.col("parent_id")),
        "depth": F.when(F.col("is_root"), 0).otherwise(1),
    }
    if with_path:
        columns["path"] = F.array(F.col("s"))
    moving = materialize(node.withColumns(columns).drop("is_root", "parent_id", "s"), "depth")
    names, arrived, open_before = moving.columns, None, None
    while True:
        done, moving = moving.filter(F.col("up").isNull()), moving.filter(F.col("up").isNotNull())
        arrived = done if arrived is None else arrived.unionByName(done)
        still_open = moving.count()
        if still_open == 0 or still_open == open_before:
            break
        open_before = still_open
        above = arrived.unionByName(moving).select(
            *TRACE,
            F.col("span_id").alias("up"),
            F.col("up").alias("__up"),
            F.col("depth").alias("__d"),
            *([F.col("path").alias("__p")] if with_path else []),
        )
        moved = {"up": F.col("__up"), "depth": F.col("depth") + F.col("__d")}
        if with_path:
            moved["path"] = F.concat("__p", "path")
        moving = materialize(moving.join(above, [*TRACE, "up"]).withColumns(moved).select(*names), "depth")
    path = ["path"] if with_path else []
    reached = arrived.select(*SPAN, "depth", F.lit(True).alias("reached"), *path)
    circling = moving.select(*SPAN, F.lit(0).alias("depth"), F.lit(False).alias("reached"), *path)
    return reached.unionByName(circling)


def self_time(links: DataFrame) -> DataFrame:
    """Own time of each span in ms: its duration less that of its children, never negative."""
    children = (
        links.filter("has_parent")
        .groupBy(*TRACE, F.col("parent_id").alias("span_id"))
        .agg(F.sum(S.positive_ms(F.col("duration_us"))).alias("children_ms"))
    )
    own = last_per_id(links, "duration_us")
    return own.join(children, SPAN, "left").select(
        *SPAN,
        F.greatest(
            F.lit(0.0), S.positive_ms(F.col("duration_us")) - F.coalesce(F.col("children_ms"), F.lit(0.0))
        ).alias("self_ms"),
    )


def with_self_time(links: DataFrame) -> DataFrame:
    return links.join(self_time(links), SPAN)


def error_spans(spans: DataFrame) -> DataFrame:
    return spans.filter("is_error")


def timeout_child() -> Column:
    """Child that ate its timed-out parent's time; on rows with parent facts and `self_ms`."""
    parent_us = F.when(F.col("parent_duration_us") > 0, F.col("parent_duration_us")).otherwise(F.lit(1.0))
    return (
        F.col("has_parent")
        & F.coalesce(F.col("parent_timeout"), F.lit(False))
        & (
            (F.col("duration_us") >= F.lit(K.CHILD_SHARE_OF_TIMEOUT) * parent_us)
            | (F.col("self_ms") >= F.lit(K.CHILD_SELF_SHARE_OF_TIMEOUT) * (parent_us / 1000.0))
        )
    )


def timeout_children(timed: DataFrame) -> DataFrame:
    return timed.filter(timeout_child())


def baseline_p99(baseline: DataFrame) -> DataFrame:
    """p99 of the whole duration per (case, service, operation) with at least three spans."""
    durations = baseline.select("case_id", "service", "operation", S.positive_ms(F.col("duration_us")).alias("ms"))
    return (
        exact_ranks(
            durations,
            ["case_id", "service", "operation"],
            "ms",
            0.99,
            {"p99_ms": lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(0.99)))},
        )
        .filter(F.col("n") >= K.BASELINE_MIN_SPANS)
        .withColumnRenamed("n", "spans")
    )


def mark_bottlenecks(timed: DataFrame, p99: DataFrame) -> DataFrame:
    """Add `is_bottleneck`: own time above twice the baseline p99 and above the floor."""
    limit = F.greatest(F.lit(K.BOTTLENECK_FLOOR_MS), F.col("p99_ms") * K.BOTTLENECK_FACTOR)
    return timed.join(
        p99.select("case_id", "service", "operation", "p99_ms"), ["case_id", "service", "operation"], "left"
    ).withColumn("is_bottleneck", F.coalesce(F.col("self_ms") > limit, F.lit(False)))


def bottlenecks(timed: DataFrame, p99: DataFrame) -> DataFrame:
    return mark_bottlenecks(timed, p99).filter("is_bottleneck")


def span_facts(spans: DataFrame) -> DataFrame:
    """One row per incident span with every fact later steps use; written once, read many times.

    Takes labelled spans of both phases with the columns of `with_error_facts`.
    """
    baseline, incident = spans.filter("phase = 'baseline'"), spans.filter("phase = 'incident'")
    marked = mark_roots(link_spans(incident))
    depth = span_depth(marked)
    # Written first, the limits are broadcast by their size; spans stay dealt by their ids for the join with depths.
    timed = mark_bottlenecks(with_self_time(marked), materialize(baseline_p99(baseline), "p99"))
    facts = timed.join(depth, SPAN).withColumn("is_timeout_child", timeout_child())
    return materialize(facts, "span-facts")


def candidates(facts: DataFrame) -> DataFrame:
    """Anomalous spans with their class: 0 error, 1 child of a timeout, 2 bottleneck."""
    kind = F.when(F.col("is_error"), 0).when(F.col("is_timeout_child"), 1).otherwise(2)
    return facts.filter("is_error OR is_timeout_child OR is_bottleneck").withColumn("class", kind)


def leaf_culprit(facts: DataFrame) -> DataFrame:
    """Deepest anomalous span per trace; errors before timeout children before bottlenecks."""
    within = F.when(F.col("class") == 1, F.col("parent_seq")).otherwise(F.col("seq"))
    rank = F.struct(-F.col("depth"), F.col("class"), within, F.col("seq"))
    leaf = F.struct(
        "span_id", "parent_id", "service", "operation", "duration_us", "self_ms",
        "status_code", "error_code", "error_message", "depth", "class", "trace_start_us",
    )
    return candidates(facts).groupBy(*TRACE).agg(F.min_by(leaf, rank).alias("l")).select(*TRACE, "l.*")


def trace_culprit(leafs: DataFrame) -> DataFrame:
    """Voted culprit service and the deepest culprit span of every case."""
    seen = F.struct("trace_start_us", "trace_id")
    votes = leafs.groupBy("case_id", "service").agg(
        (F.count(F.lit(1)) * K.VOTES_PER_TRACE).alias("votes"), F.min(seen).alias("seen")
    )
    winner = votes.groupBy("case_id").agg(
        F.min_by(F.struct("service", "votes"), F.struct(-F.col("votes"), F.col("seen"))).alias("w")
    )
    span = F.struct("trace_id", "span_id", "service", "operation", "duration_us", "status_code", "depth")
    deepest = leafs.groupBy("case_id").agg(
        F.min_by(span, F.struct(-F.col("depth"), F.col("trace_start_us"), F.col("trace_id"))).alias("s")
    )
    return winner.join(deepest, "case_id").select(
        "case_id",
        F.col("w.service").alias("culprit_service"),
        F.col("w.votes").alias("votes"),
        F.col("s.trace_id").alias("culprit_trace_id"),
        F.col("s.span_id").alias("culprit_span_id"),
        F.col("s.service").alias("span_service"),
        F.col("s.operation").alias("span_operation"),
        F.col("s.duration_us").alias("span_duration_us"),
        F.col("s.status_code").alias("span_status_code"),
        F.col("s.depth").alias("leaf_depth"),
    )


def top_span_evidence(facts: DataFrame, limit: int = K.MAX_EVIDENCE_SPANS) -> DataFrame:
    """First spans of each evidence list, in trace order."""
    kinds = F.filter(
        F.array(
            F.when(F.col("is_error"), F.lit("error")), F.when(F.col("is_bottleneck"), F.lit("bottleneck"))
        ),
        lambda k: k.isNotNull(),
    )
    order = Window.partitionBy("case_id", "kind").orderBy("trace_start_us", "trace_id", "seq", "span_id")
    return (
        facts.filter("is_error OR is_bottleneck")
        .withColumn("kind", F.explode(kinds))
        .withColumn("evidence_rank", F.row_number().over(order))
        .filter(F.col("evidence_rank") <= limit)
    )


def trace_evidence(facts: DataFrame, leafs: DataFrame) -> DataFrame:
    """Totals, root service and culprit per case."""
    totals = facts.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if("is_error").alias("error_spans"),
        F.count_if("is_bottleneck").alias("bottlenecks"),
        F.min(F.when(F.col("is_root"), F.col("service"))).alias("root_service"),
    )
    traces = facts.select(*TRACE).distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("traces"))
    return totals.join(traces, "case_id").join(trace_culprit(leafs), "case_id", "left")


def failing_traces(facts: DataFrame, limit: int = K.MAX_CALL_TREES) -> DataFrame:
    """First failing traces of each case in trace order."""
    order = Window.partitionBy("case_id").orderBy("trace_start_us", "trace_id")
    return (
        facts.filter("is_error OR is_bottleneck")
        .select("case_id", "trace_id", "trace_start_us")
        .distinct()
        .withColumn("trace_rank", F.row_number().over(order))
        .filter(F.col("trace_rank") <= limit)
    )


def call_tree(facts: DataFrame, leafs: DataFrame, limit: int = K.MAX_CALL_TREES) -> DataFrame:
    """Lines of the call trees: (case, trace_rank, path, line), depth first.

    The culprit mark is the deepest leaf found up to that trace. Paths are only built for these traces.
    """
    first = materialize(failing_traces(facts, limit), "failing-traces")
    shown = materialize(facts.join(first.select(*TRACE), TRACE, "left_semi"), "shown-spans")
    facts = shown.drop("depth", "reached").join(span_depth(shown, with_path=True), SPAN)
    upto = Window.partitionBy("case_id").orderBy("trace_rank").rowsBetween(Window.unboundedPreceding, 0)
    marks = first.join(
        leafs.select(*TRACE, F.col("span_id").alias("leaf_id"), F.col("depth").alias("leaf_depth")), TRACE
    ).select(
        *TRACE,
        "trace_rank",
        F.min_by("leaf_id", F.struct(-F.col("leaf_depth"), F.col("trace_rank"))).over(upto).alias("marked_id"),
    )
    label = F.when(
        F.col("is_error"),
        F.concat(F.lit(" [ERROR "), F.coalesce(F.nullif("status_code", F.lit(0)).cast("string"), F.lit("")), F.lit("]")),
    ).when(F.col("is_bottleneck"), F.lit(" [LATENCY BOTTLENECK]")).otherwise(F.lit(""))
    indent = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") > 0, F.lit("↳ ")).otherwise(F.lit("")))
    line = F.concat(
        indent, F.col("service"), F.lit(":"), F.col("operation"), F.lit(" ("),
        fixed(S.positive_ms(F.col("duration_us")), 1), F.lit("ms)"), label,
        F.when(F.col("span_id") == F.col("marked_id"), F.lit(" <--- [LEAF CULPRIT]")).otherwise(F.lit("")),
    )
    body = facts.filter("reached").join(marks, TRACE).select("case_id", "trace_id", "trace_rank", "path", line.alias("line"))
    heads = first.select(
        "case_id", "trace_id", "trace_rank", F.array().cast("array<bigint>").alias("path"),
        F.concat(F.lit("Trace "), F.col("trace_id"), F.lit(":")).alias("line"),
    )
    return heads.unionByName(body)


def call_tree_text(lines: DataFrame, readable: int | None = None) -> DataFrame:
    """Call-tree text of each case and its length.

    With `readable`, the number of characters that somebody will read of it, lines that cannot be among them are left
    out of the text (a line takes at least 8 characters with its break); the length still tells of all.
    """
    order = Window.partitionBy("case_id").orderBy("trace_rank", "path")
    size = lines.groupBy("case_id").agg(
        (F.sum(F.length("line") + 1) - 1 + (F.count_distinct("trace_rank") - 1)).alias("tree_chars")
    )
    shown = lines.withColumn("__r", F.row_number().over(order))
    if readable is not None:
        shown = shown.filter(F.col("__r") <= readable // 8 + 1)
    # A blank line parts two trees: every head but the first brings an extra line break.
    piece = F.when((F.size("path") == 0) & (F.col("__r") > 1), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    texts = (
        shown.groupBy("case_id")
        .agg(F.sort_array(F.collect_list(F.struct("__r", piece.alias("p")))).alias("__l"))
        .select("case_id", F.array_join(F.transform("__l", lambda x: x["p"]), "\n").alias("tree"))
    )
    return size.join(texts, "case_id")


def trace_text(evidence: DataFrame, trees: DataFrame) -> DataFrame:
    """Trace section of each case and its whole length."""
    d = evidence.join(trees, "case_id", "left")
    status = F.coalesce(
        F.nullif("span_status_code", F.lit(0)).cast("string"),
        F.when(F.col("error_spans") > 0, F.lit("ERROR")).otherwise(F.lit("LATENCY_ANOMALY")),
    )
    head = F.concat_ws(
        "\n",
        F.lit("### Distributed Trace Analysis:"),
        F.concat(
            F.lit("- Total Traces: "), F.col("traces"), F.lit(", Failing Spans: "), F.col("error_spans"),
            F.lit(", Latency Bottlenecks: "), F.col("bottlenecks"),
        ),
        F.concat(F.lit("- Isolated Culprit Service: '"), F.col("culprit_service"), F.lit("'")),
        F.concat(
            F.lit("- Deepest Leaf Culprit Span: "), F.col("span_service"), F.lit(":"), F.col("span_operation"),
            F.lit(" (status="), status, F.lit(", duration="), fixed(S.positive_ms(F.col("span_duration_us")), 1),
            F.lit("ms, depth="), F.col("leaf_depth"), F.lit(")"),
        ),
        F.when(F.col("tree").isNotNull(), F.lit("\nCall Hierarchy DAG:")),
    )
    calm = F.concat(
        F.lit("Evaluated "), F.col("traces"),
        F.lit(" distributed traces. No span error codes or anomalies detected."),
    )
    quiet = (F.col("error_spans") == 0) & (F.col("bottlenecks") == 0)
    return d.select(
        "case_id",
        F.when(quiet, calm).otherwise(F.concat_ws("\n", head, "tree")).alias("text"),
        F.when(quiet, F.length(calm))
        .otherwise(F.length(head) + F.coalesce(F.col("tree_chars") + 1, F.lit(0)))
        .alias("text_chars"),
    )


def dedup_traces(spans: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Drop spans captured twice by overlapping requests; of differing copies the first by `order` stays."""
    row = F.struct(*[F.col(c) for c in spans.columns])
    first = spans.groupBy(*SPAN).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return first.select(*[F.col(f"__row.{c}").alias(c) for c in spans.columns])
