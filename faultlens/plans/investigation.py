"""End-to-end investigation: raw telemetry of all cases → ranked, explained and scored reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.operators import context, evaluation, fusion, logs, metrics, templates, traces, windows
from faultlens.plans.materialize import materialize
from faultlens.sources.bounds import Bounds, bounds_of


@dataclass
class Investigation:
    """Lazy stages over all cases. Evidence shared by several stages is written once.

    `raw_logs(case_id, service, ts, message, seq)`, `raw_points(case_id, metric_name, query, ts, value,
    seq)`, `raw_spans` as in `operators.traces`, `cases(case_id, inject_time, gt_service, gt_fault)`. A case without
    baseline lines is held against `saved_templates(template)`, if given.
    """

    cases: DataFrame
    raw_logs: DataFrame
    raw_points: DataFrame
    raw_spans: DataFrame
    baseline_seconds: float = K.BASELINE_SECONDS
    incident_seconds: float = K.INCIDENT_SECONDS
    template_source: str = "signature"
    saved_templates: DataFrame | None = None
    context_before: int = K.CONTEXT_BEFORE
    context_after: int = K.CONTEXT_AFTER
    log_tokens: int = K.LOG_TOKEN_BUDGET
    context_tokens: int = K.CONTEXT_TOKENS
    z_threshold: float = K.Z_THRESHOLD
    slope_limit: float = K.OOM_SLOPE_BYTES_PER_SECOND
    alert_count: int = K.MAX_ALERTS
    modes: tuple[str, ...] = K.MODES

    def __post_init__(self) -> None:
        # Written once, so that Spark knows how small it is: joins with raw rows then broadcast it by its size.
        self.cases = materialize(self.cases, "cases")

    # --- slices -----------------------------------------------------------------------------
    @cached_property
    def bounds(self) -> Bounds:
        """The windows of all cases as literals, so that scans of logs and points can pass over the rest."""
        return bounds_of(self.cases, self.baseline_seconds, self.incident_seconds)

    @cached_property
    def lines(self) -> DataFrame:
        return windows.number_lines(self.labelled_logs)

    @cached_property
    def labelled_logs(self) -> DataFrame:
        return windows.label_phase(self.raw_logs, self.cases, self.baseline_seconds, self.incident_seconds, self.bounds)

    @cached_property
    def points(self) -> DataFrame:
        """Sliced points; six narrow columns that every metric stage reads."""
        sliced = windows.label_phase(self.raw_points, self.cases, self.baseline_seconds, self.incident_seconds, self.bounds)
        return materialize(sliced, "points")

    @cached_property
    def spans(self) -> DataFrame:
        return windows.label_trace_phase(self.raw_spans, self.cases, self.baseline_seconds, self.incident_seconds)

    @cached_property
    def slim_spans(self) -> DataFrame:
        """Sliced spans with their error facts in place of tags and logs, which are not shuffled.

        Slicing reads spans twice, for the start of each trace and for their rows, so they are written before.
        """
        slim = materialize(traces.with_error_facts(self.raw_spans), "slim-spans")
        return materialize(windows.label_trace_phase(slim, self.cases, self.baseline_seconds, self.incident_seconds), "spans")

    # --- logs -------------------------------------------------------------------------------
    @cached_property
    def incident_lines(self) -> DataFrame:
        """Numbered lines after the injection, the one stored copy of their texts."""
        if self.template_source == "mined":
            return self.lines.filter("phase = 'incident'")
        return windows.number_lines(self.labelled_logs.filter("phase = 'incident'"))

    @cached_property
    def annotated(self) -> DataFrame:
        """Incident lines with template, novelty, keyword and probe facts."""
        if self.template_source == "mined":
            judged = templates.classify_lines(self.lines)
        else:
            # The baseline only lends its signatures, so its lines need no numbers. They are dealt out first: a raw
            # file gives no more tasks than it has row groups, and signatures cost far more than reading.
            calm = windows.as_lines(self.labelled_logs.filter("phase = 'baseline'").repartition("seq"))
            known = logs.with_signatures(calm).select("case_id", "template")
            judged = logs.flag_novel(logs.with_signatures(self.incident_lines), known, self.saved_templates)
        return logs.annotate(judged)

    @cached_property
    def positioned(self) -> DataFrame:
        """Facts of annotated lines with running positions; no texts but the templates of candidates."""
        wanted = F.when(F.col("keyword").isNotNull() | F.col("is_novel"), F.col("template"))
        kept = self.annotated.select("case_id", "service", "line_no", wanted.alias("template"), "is_novel", "keyword", "probe")
        return logs.with_positions(kept)

    @cached_property
    def log_windows(self) -> DataFrame:
        return logs.merge_windows(self.positioned, self.context_before, self.context_after)

    @cached_property
    def targets(self) -> DataFrame:
        return logs.with_texts(logs.primary_target(self.log_windows), self.incident_lines)

    @cached_property
    def snippets(self) -> DataFrame:
        found = logs.snippets(self.targets, self.positioned, self.context_before, self.context_after, lines=self.incident_lines)
        return materialize(found, "snippets")

    @cached_property
    def log_evidence(self) -> DataFrame:
        return logs.log_evidence(self.snippets, logs.novel_counts(self.positioned))

    @cached_property
    def kept_logs(self) -> DataFrame:
        return materialize(logs.budget_services(self.log_evidence, self.snippets, self.log_tokens), "kept-logs")

    # --- metrics ----------------------------------------------------------------------------
    @cached_property
    def evaluated(self) -> DataFrame:
        return materialize(metrics.evaluate(self.points, self.z_threshold, self.slope_limit), "evaluated")

    @cached_property
    def alerts(self) -> DataFrame:
        return metrics.alert_text(metrics.alerts(self.evaluated))

    @cached_property
    def top_alerts(self) -> DataFrame:
        return metrics.top_alerts(self.alerts, self.alert_count)

    @cached_property
    def metric_evidence(self) -> DataFrame:
        return metrics.metric_evidence(self.evaluated, self.alerts, self.top_alerts)

    # --- traces -----------------------------------------------------------------------------
    @cached_property
    def facts(self) -> DataFrame:
        return traces.span_facts(self.slim_spans)

    @cached_property
    def edges(self) -> DataFrame:
        return traces.service_edges(self.facts)

    @cached_property
    def leafs(self) -> DataFrame:
        return traces.leaf_culprit(self.facts)

    @cached_property
    def trace_evidence(self) -> DataFrame:
        return materialize(traces.trace_evidence(self.facts, self.leafs), "trace-evidence")

    @cached_property
    def call_tree(self) -> DataFrame:
        return traces.call_tree(self.facts, self.leafs)

    @cached_property
    def trace_text(self) -> DataFrame:
        """Trace section as far as a context can read it."""
        return traces.trace_text(self.trace_evidence, traces.call_tree_text(self.call_tree, self.context_tokens * 3))

    # --- fusion -----------------------------------------------------------------------------
    @cached_property
    def ranking(self) -> DataFrame:
        return fusion.ranking(self.kept_logs, self.top_alerts, self.trace_evidence, self.edges, self.modes)

    @cached_property
    def signals(self) -> DataFrame:
        return fusion.case_signals(
            self.cases, self.kept_logs, self.metric_evidence, self.top_alerts, self.trace_evidence, self.modes
        )

    @cached_property
    def diagnosis(self) -> DataFrame:
        """One row per (case, mode): ranking, category, confidence, primary signal."""
        judged = fusion.category(fusion.category_likelihoods(self.signals))
        ranked = fusion.with_ranking(judged, self.ranking)
        return materialize(fusion.primary_signal(fusion.confidence(ranked)), "diagnosis")

    @cached_property
    def reports(self) -> DataFrame:
        told = fusion.triangulation(self.diagnosis, self.kept_logs, self.top_alerts)
        return fusion.rca_report(told)

    @cached_property
    def sections(self) -> DataFrame:
        return context.budget_sections(
            self.cases, self.kept_logs, self.metric_evidence, self.trace_text, self.edges, self.modes, self.context_tokens
        )

    @cached_property
    def contexts(self) -> DataFrame:
        return context.build_context(self.sections, self.context_tokens)

    # --- evaluation -------------------------------------------------------------------------
    @cached_property
    def scores(self) -> DataFrame:
        return materialize(evaluation.score_cases(fusion.rca_report(self.diagnosis), self.cases), "scores")

    @cached_property
    def artifacts(self) -> DataFrame:
        debug = fusion.fusion_debug(self.diagnosis)
        return materialize(
            evaluation.build_artifacts(self.reports, self.scores, self.contexts, debug, self.context_tokens), "artifacts"
        )
