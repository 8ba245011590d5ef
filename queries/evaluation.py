"""Scores, aggregates, look-ups, result tables and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.operators import checks as Ch
from faultlens.operators import evaluation as E
from faultlens.operators import traces as T
from faultlens.plans.materialize import scratch_path
from faultlens.sources import results as R
from faultlens.sources.result_store import ResultStore
from oracles.stages import fmt, metric_service_sql
from queries.common import investigation, rounded, rounded_sql
from queries.windows import written_files, FILES_SQL

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


FACTS = "ground_truth_service, predicted_service, ranked_candidates, ground_truth_fault, predicted_category, top1_hit, top3_hit, fault_match, error_bucket"


@register(f"SELECT case_id, mode, {FACTS}, {rounded_sql('mrr', 'confidence')} FROM scores")
def score_cases(spark, sf):
    return investigation(spark, sf).scores.withColumn("ranked_candidates", F.array_join("ranked_candidates", ";")).select(
        "case_id", "mode", *FACTS.split(", "), *rounded("mrr", "confidence")
    )


RATES = "count(*) AS cases, avg(top1_hit::INT) AS top1, avg(top3_hit::INT) AS top3, avg(mrr) AS mrr, avg(fault_match::INT) AS fault_acc"
FOUR = ("top1", "top3", "mrr", "fault_acc")


@register(
    f"""SELECT mode, fault, cases, {rounded_sql(*FOUR)} FROM (SELECT mode, fault, {RATES} FROM (SELECT *, upper(ground_truth_fault) AS fault FROM scores)
        GROUP BY GROUPING SETS ((mode), (mode, fault)))"""
)
def aggregate_scores(spark, sf):
    return E.aggregate_scores(investigation(spark, sf).scores).select("mode", "fault", "cases", *rounded(*FOUR))


@register("SELECT mode, error_bucket, count(*) AS cases FROM scores GROUP BY ALL")
def bucket_counts(spark, sf):
    return E.bucket_counts(investigation(spark, sf).scores)


LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.FAULT_LABELS.items())


@register(
    f"""SELECT mode, ground_truth_fault AS fault, CASE ground_truth_fault {LABELS} ELSE ground_truth_fault END AS label, count(*) AS total,
        round(avg(top1_hit::INT) * 100, 1) AS top1_pct, round(avg(top3_hit::INT) * 100, 1) AS top3_pct, round(avg(CAST(mrr AS DOUBLE)), 4) AS mrr FROM scores GROUP BY ALL"""
)
def fault_breakdown(spark, sf):
    return E.fault_breakdown(investigation(spark, sf).scores)


@register(
    f"""SELECT mode, part, name, cases, {rounded_sql(*FOUR)} FROM (
        SELECT mode, 'overall' AS part, 'all' AS name, {RATES} FROM scores WHERE mode = 'fusion' GROUP BY mode
        UNION ALL SELECT mode, 'fault', ground_truth_fault, {RATES} FROM scores WHERE mode = 'fusion' GROUP BY mode, ground_truth_fault
        UNION ALL SELECT mode, 'bucket', error_bucket, count(*), NULL, NULL, NULL, NULL FROM scores WHERE mode = 'fusion' GROUP BY mode, error_bucket)"""
)
def mode_summary(spark, sf):
    return E.mode_summary(investigation(spark, sf).scores, "fusion").select("mode", "part", "name", "cases", *rounded(*FOUR))


@register(f"SELECT mode, cases, {rounded_sql(*FOUR)} FROM (SELECT mode, {RATES} FROM scores GROUP BY mode)")
def compare_modes(spark, sf):
    return E.compare_modes(investigation(spark, sf).scores).select("mode", "cases", *rounded(*FOUR))


# Score rows that count as stored for the look-ups below, and those with an artifact.
STORED = "NOT (mode = 'logs-traces' AND top1_hit) AND case_id NOT LIKE '%cpu%'"
KEPT = "mode IN ('fusion', 'logs-only') AND case_id NOT LIKE '%mem%'"


def _stored(inv):
    return inv.scores.filter(STORED), inv.scores.filter(KEPT)


@register(
    f"""SELECT c.case_id, c.mode, s.case_id IS NOT NULL AS scored, s.predicted_service, s.top1_hit, s.top3_hit, round(CAST(s.mrr AS DOUBLE), 4) AS mrr
        FROM case_modes c LEFT JOIN (SELECT * FROM scores WHERE {STORED}) s USING (case_id, mode)"""
)
def mode_coverage(spark, sf):
    inv = investigation(spark, sf)
    return E.mode_coverage(inv.cases, _stored(inv)[0]).withColumn("mrr", F.round("mrr", 4))


@register(
    f"""SELECT c.case_id, c.gt_fault, s.case_id IS NOT NULL AS scored, a.case_id IS NOT NULL AS has_artifact, s.predicted_service, s.error_bucket, round(CAST(s.mrr AS DOUBLE), 4) AS mrr
        FROM v_cases c LEFT JOIN (SELECT * FROM scores WHERE mode = 'fusion' AND {STORED}) s USING (case_id)
        LEFT JOIN (SELECT * FROM scores WHERE mode = 'fusion' AND {KEPT}) a USING (case_id)"""
)
def list_cases(spark, sf):
    inv = investigation(spark, sf)
    return E.list_cases(inv.cases, *_stored(inv)).select(
        "case_id", "gt_fault", "scored", "has_artifact", "predicted_service", "error_bucket", F.round("mrr", 4).alias("mrr")
    )


@register(
    f"""WITH f AS ({FILES_SQL}), m AS (SELECT case_id, string_agg(mode, ',' ORDER BY mode) AS modes FROM scores WHERE {KEPT} GROUP BY case_id)
        SELECT c.case_id, c.gt_fault, bool_or(file_name = 'logs.parquet') AS has_logs_file, bool_or(file_name = 'inject_time.txt') AS has_inject_time_file,
        bool_or(file_name = 'traces.parquet') AS has_traces_bytes, coalesce(any_value(m.modes), '') AS modes
        FROM v_cases c JOIN f USING (case_id) LEFT JOIN m USING (case_id) GROUP BY ALL"""
)
def file_inventory(spark, sf):
    inv = investigation(spark, sf)
    return E.file_inventory(inv.cases, written_files(spark, inv), _stored(inv)[1]).select(
        "case_id", "gt_fault", "has_logs_file", "has_inject_time_file", (F.col("traces_bytes") > 0).alias("has_traces_bytes"), F.array_join("modes", ",").alias("modes")
    )


@register(
    f"""SELECT c.case_id, c.mode, CASE WHEN a.case_id IS NOT NULL THEN 'cache' WHEN s.case_id IS NOT NULL THEN 'csv_summary' ELSE 'absent' END AS source,
        coalesce(a.case_id, s.case_id) IS NOT NULL AS found, a.case_id IS NOT NULL AS has_artifact, coalesce(a.predicted_service, s.predicted_service) AS predicted_service,
        coalesce(a.top1_hit, s.top1_hit) AS top1_hit, round(CAST(coalesce(a.mrr, s.mrr) AS DOUBLE), 4) AS mrr, round(coalesce(a.confidence, s.confidence), 4) AS confidence
        FROM case_modes c LEFT JOIN (SELECT * FROM scores WHERE {KEPT}) a USING (case_id, mode) LEFT JOIN (SELECT * FROM scores WHERE {STORED}) s USING (case_id, mode)"""
)
def best_result(spark, sf):
    inv = investigation(spark, sf)
    scores, artifacts = _stored(inv)
    return E.best_result(inv.cases, artifacts, scores).withColumns({"mrr": F.round("mrr", 4), "confidence": F.round("confidence", 4)})


def _pivot(slug, mode):
    pick = lambda c: f"max(CASE WHEN mode = '{mode}' THEN {c} END)"
    flag = f"bool_or(top1_hit) FILTER (WHERE mode = '{mode}')"
    return (
        f"{pick('predicted_service')} AS {slug}_pred, {flag} AS {slug}_top1, round(CAST({pick('mrr')} AS DOUBLE), 4) AS {slug}_mrr, {pick('error_bucket')} AS {slug}_bucket"
    )


@register(
    "SELECT case_id, ground_truth_service, ground_truth_fault, "
    + ", ".join(_pivot(m.replace("-", "_"), m) for m in K.MODES)
    + " FROM scores GROUP BY ALL"
)
def comparison_table(spark, sf):
    t = E.comparison_table(investigation(spark, sf).scores)
    return t.withColumns({c: F.round(c, 4) for c in t.columns if c.endswith("_mrr")})


ARTIFACT_COUNTS = "log_services, snippets AS log_snippets, novel_templates, alerts AS metric_alerts, oom_alerts, traces AS trace_total, spans AS trace_spans, error_spans AS trace_errors, bottlenecks AS trace_bottlenecks"


@register(
    f"""SELECT d.case_id, d.mode, {', '.join(f'd.{p}' for p in ARTIFACT_COUNTS.split(', '))}, d.top_service AS root_cause_service, d.category AS failure_category,
        s.error_bucket, length(c.context) AS context_chars FROM diagnosis d JOIN scores s USING (case_id, mode) JOIN contexts c USING (case_id, mode)"""
)
def build_artifacts(spark, sf):
    return investigation(spark, sf).artifacts.select(
        "case_id", "mode", "summary_counts.*", "report.root_cause_service", "report.failure_category", "evaluation.error_bucket",
        F.length("prompt.preview").alias("context_chars"),
    )


SLIM = "case_id, mode, predicted_service, top1_hit, CAST(round(CAST(confidence AS DOUBLE), 2) AS DOUBLE) AS confidence"


def _old_and_new(inv):
    slim = inv.scores.select("case_id", "mode", "predicted_service", "top1_hit", F.round("confidence", 2).alias("confidence"))
    old = slim.filter("mode <> 'logs-traces'").withColumn("created_at", F.lit(1))
    new = (
        slim.filter("mode IN ('fusion', 'logs-traces')")
        .withColumns({"predicted_service": F.concat("predicted_service", F.lit("-new")), "created_at": F.lit(2)})
    )
    return old, new


OLD_NEW = f"""old AS (SELECT {SLIM}, 1 AS created_at FROM scores WHERE mode <> 'logs-traces'),
 new AS (SELECT {SLIM.replace('predicted_service', "concat(predicted_service, '-new') AS predicted_service")}, 2 AS created_at FROM scores WHERE mode IN ('fusion', 'logs-traces'))"""


@register(
    f"""WITH {OLD_NEW} SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mode ORDER BY created_at DESC) AS i
        FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) WHERE i = 1"""
)
def upsert_results(spark, sf):
    return R.upsert_results(*_old_and_new(investigation(spark, sf)))


@register(f"WITH {OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE (case_id, mode) NOT IN (SELECT (case_id, mode) FROM old)")
def insert_missing(spark, sf):
    return R.insert_missing(*_old_and_new(investigation(spark, sf)))


def _store(spark):
    return ResultStore(spark, scratch_path(spark, "results"), buckets=4)


@register(SQL["upsert_results"])
def store_upsert(spark, sf):
    """Two batches of results in a store; the second one comes twice and rewrites the parts of its cases only."""
    store, (old, new) = _store(spark), _old_and_new(investigation(spark, sf))
    store.upsert(old, "0")
    for _ in range(2):
        store.upsert(new, "1")
    return store.read()


@register(SQL["insert_missing"])
def store_insert_missing(spark, sf):
    store, (old, new) = _store(spark), _old_and_new(investigation(spark, sf))
    store.append(old, "0")
    store.insert_missing(new, "1")
    return store.read()


SIDES = """SELECT case_id, phase, ts, 'logs' AS signal FROM lines UNION ALL SELECT case_id, phase, ts, 'metrics' FROM points
 UNION ALL SELECT case_id, phase, start_us / 1000000.0, 'traces' FROM spans"""


@register(
    f"""SELECT case_id, concat(signal, ' baseline strictly before injection') AS name, b < 1705708800.0 AND 1705708800.0 <= i AS ok,
        concat('max_base=', {fmt('b', 3)}, ' min_inc=', {fmt('i', 3)}) AS detail
        FROM (SELECT case_id, signal, max(ts) FILTER (WHERE phase = 'baseline') AS b, min(ts) FILTER (WHERE phase = 'incident') AS i FROM ({SIDES}) GROUP BY ALL)
        WHERE b IS NOT NULL AND i IS NOT NULL"""
)
def check_phase_order(spark, sf):
    inv = investigation(spark, sf)
    return Ch.phase_order(inv.lines, inv.points, inv.spans, inv.cases)


@register(
    """WITH t AS (SELECT case_id, trace_id, count(*) AS n, count(*) FILTER (WHERE parent_id IS NOT NULL AND NOT has_parent) AS o, count(*) FILTER (WHERE parent_id IS NULL) AS r
         FROM links WHERE NOT (seq = 1 AND service = 'svc5') GROUP BY ALL),
       c AS (SELECT case_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(o) AS BIGINT) AS o, count(*) FILTER (WHERE r = 1) AS w, count(*) AS k FROM t GROUP BY ALL)
       SELECT case_id, 'trace DAG has no orphaned spans' AS name, o = 0 AS ok, concat(o, '/', n, ' orphaned, ', w, '/', k, ' traces have exactly one root') AS detail FROM c
       UNION ALL SELECT case_id, 'at least one incident trace', k > 0, concat(k, ' traces / ', n, ' spans') FROM c""".replace(
        "FROM links WHERE NOT (seq = 1 AND service = 'svc5')",
        "FROM (SELECT c.*, p.span_id IS NOT NULL AS has_parent FROM cut_spans c LEFT JOIN cut_spans p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id)",
    ).replace("WITH t AS", "WITH cut_spans AS (SELECT * FROM inc_spans WHERE NOT (seq = 1 AND service = 'svc5')), t AS")
)
def check_trace_shape(spark, sf):
    # Some roots are withheld so that the check has something to find.
    spans = investigation(spark, sf).slim_spans.filter("phase = 'incident' AND NOT (seq = 1 AND service = 'svc5')")
    return Ch.trace_shape(T.link_spans(spans))


@register(
    f"""WITH t AS (SELECT DISTINCT case_id, service FROM spans WHERE phase = 'incident'),
        o AS (SELECT case_id, {metric_service_sql('metric_name', 'query')} AS service FROM points WHERE phase = 'incident' AND service <> 'svc4'
              UNION SELECT case_id, service FROM lines WHERE phase = 'incident' AND service <> 'svc4')
        SELECT case_id, 'trace services overlap metric/log service names' AS name, count(o.service) > 0 AS ok,
        concat('trace_only=', coalesce(string_agg(t.service, ',' ORDER BY t.service) FILTER (WHERE o.service IS NULL), '')) AS detail
        FROM t LEFT JOIN o USING (case_id, service) GROUP BY case_id""".replace(
        "FROM points WHERE phase = 'incident' AND service <> 'svc4'", "FROM points WHERE phase = 'incident' AND NOT starts_with(metric_name, 'svc4_')"
    )
)
def check_service_overlap(spark, sf):
    inv = investigation(spark, sf)
    inside = lambda df: df.filter("phase = 'incident'")
    return Ch.service_overlap(
        inside(inv.spans), inside(inv.points).filter("NOT startswith(metric_name, 'svc4_')"), inside(inv.lines).filter("service <> 'svc4'")
    )


@register(
    """SELECT case_id, 'metric z-scores reproducible from stored stats' AS name, count(*) FILTER (WHERE std <> 0 AND abs((peak - mean) / std - z) > 1e-6) = 0 AS ok,
       concat(count(*) FILTER (WHERE std <> 0 AND abs((peak - mean) / std - z) > 1e-6), ' of ', count(*), ' alerts mismatch') AS detail FROM top_alerts GROUP BY case_id"""
)
def check_z_reproducible(spark, sf):
    return Ch.z_reproducible(investigation(spark, sf).top_alerts)


@register(
    """WITH d AS (SELECT c.case_id, c.mode, context, greatest(1, length(context) // 3) AS tk, split_part(context, chr(10), 1) AS line1,
          (SELECT count(*) FROM ranking r WHERE r.case_id = c.case_id AND r.mode = c.mode) AS n, g.confidence FROM contexts c JOIN diagnosis g USING (case_id, mode))
       SELECT case_id, concat(mode, ': ', rule[1]) AS name, rule[2] = 'true' AS ok, concat(tk, ' tokens') AS detail FROM (
         SELECT *, unnest([['context incident id is opaque', CAST(contains(line1, 'INC-') AND NOT contains(line1, case_id) AS VARCHAR)],
           ['case id does not appear in the context', CAST(NOT contains(context, case_id) AS VARCHAR)], ['context token accounting holds', CAST(tk = greatest(1, length(context) // 3) AS VARCHAR)],
           ['context under 2500 tokens', CAST(tk < 2500 AS VARCHAR)], ['ranked candidates are non-empty', CAST(n > 0 AS VARCHAR)],
           ['confidence within [0, 1]', CAST(confidence BETWEEN 0 AND 1 AS VARCHAR)]]) AS rule FROM d)"""
)
def check_context_rules(spark, sf):
    inv = investigation(spark, sf)
    return Ch.context_rules(inv.contexts, inv.diagnosis)


@register(
    f"""WITH a AS (SELECT * FROM scores WHERE {KEPT}), s AS (SELECT *, CASE WHEN ground_truth_fault = 'delay' THEN NOT top1_hit ELSE top1_hit END AS hit FROM scores WHERE {STORED}),
        x AS (SELECT a.case_id, count(*) FILTER (WHERE contains(c.context, a.case_id)) AS l, count(*) AS n FROM a JOIN contexts c USING (case_id, mode) GROUP BY a.case_id),
        d AS (SELECT a.case_id, count(*) FILTER (WHERE s.case_id IS NOT NULL AND s.hit <> a.top1_hit) AS w, count(*) FILTER (WHERE s.case_id IS NULL) AS m, count(*) AS n
              FROM a LEFT JOIN s USING (case_id, mode) GROUP BY a.case_id)
        SELECT case_id, 'artifact evaluation matches score row' AS name, w = 0 AS ok, concat(w, ' of ', n) AS detail FROM d
        UNION ALL SELECT case_id, 'every artifact has a score row', m = 0, concat(m, ' of ', n) FROM d
        UNION ALL SELECT case_id, 'no artifact context leaks the case id', l = 0, concat(l, ' of ', n) FROM x"""
)
def check_artifacts(spark, sf):
    inv = investigation(spark, sf)
    scores, artifacts = _stored(inv)
    texts = inv.contexts.select("case_id", "mode", "context")
    wrong = scores.withColumn("top1_hit", F.when(F.col("ground_truth_fault") == "delay", ~F.col("top1_hit")).otherwise(F.col("top1_hit")))
    return Ch.artifacts_match(artifacts.join(texts, ["case_id", "mode"]), wrong)


