"""Named SQL stages (DuckDB dialect) and a helper that puts the needed ones before a query."""

from __future__ import annotations

import re

from faultlens import constants as K
from faultlens.plans import views as V


def duck(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(column: str, marks) -> str:
    tests = []
    for m in marks:
        safe = m.replace("'", "''")
        tests.append(f"contains({column}, '{safe}')")
    return "(" + " OR ".join(tests) + ")"


def keyword_sql(low: str) -> str:
    whens = " ".join(f"WHEN contains({low}, '{k}') THEN '{k}'" for k in K.ERROR_KEYWORDS)
    return f"CASE {whens} END"


def mask_sql(text: str) -> str:
    for pattern, name in K.MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


def tokens_sql(masked: str) -> str:
    return f"trim(regexp_replace(translate({masked}, '_:=,[]', '      '), '\\s+', ' ', 'g'))"


def fmt(x: str, digits: int, plus: bool = False) -> str:
    return f"printf('%{'+' if plus else ''}.{digits}f', round(CAST({x} AS DOUBLE), 6))"


def fault_category_sql(fault: str) -> str:
    whens = " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in K.FAULT_TO_CATEGORY.items())
    return f"CASE upper(trim({fault})) {whens} ELSE '{K.UNKNOWN_CATEGORY}' END"


def bucket_sql(t1: str, t3: str, f: str) -> str:
    return (
        f"CASE WHEN {t1} AND {f} THEN 'hit' WHEN {t1} THEN 'category_miss' WHEN {t3} AND {f} THEN 'ranking_miss'"
        f" WHEN {f} THEN 'localization_miss' ELSE 'localization_and_category_miss' END"
    )


def truncate_sql(text: str, cap: str, length: str | None = None) -> str:
    """Cut to `cap` tokens of three characters; the mark takes 10 tokens and 2 spare ones."""
    length = length or f"length({text})"
    return (
        f"CASE WHEN greatest(1, {length} // 3) <= {cap} THEN {text} ELSE"
        f" concat(substr({text}, 1, CAST(greatest(20, greatest(1, {cap} - 12) * 3) AS BIGINT)), {MARK}) END"
    )


MARK = "chr(10) || '...[truncated for token budget]'"
NL = "chr(10)"
INJECT = f"{V.INJECT_SECONDS}.0"
EVENT_US = f"CAST({V.INJECT_SECONDS}000000 + floor(CAST(epoch_us(ts) - {V.INJECT_SECONDS}000000 AS DOUBLE) / 2000) AS BIGINT)"
SPAN_US = f"CAST({V.INJECT_SECONDS}000000 + floor(CAST(epoch_us(o_orderdate) - 915148800000000 AS DOUBLE) / 250000) AS BIGINT)"
LATE = "o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'"
PHASE = (
    f"CASE WHEN ts >= {INJECT} - {V.BASELINE_SECONDS} AND ts < {INJECT} THEN 'baseline'"
    f" WHEN ts >= {INJECT} AND ts <= {INJECT} + {V.INCIDENT_SECONDS} THEN 'incident' END"
)
LABELS = "(?:name|app|service|pod|container|service_name)"


def metric_service_sql(name: str, query: str) -> str:
    both = f"concat({name}, ' ', {query})"
    return f"""CASE
 WHEN contains({name}, '/') AND trim(split_part({name}, '/', 1)) <> '' THEN trim(split_part({name}, '/', 1))
 WHEN regexp_extract({both}, '{LABELS}="([^"]+)"', 1) <> '' THEN trim(regexp_extract({both}, '{LABELS}="([^"]+)"', 1))
 WHEN regexp_extract({both}, '{LABELS}=''([^'']+)''', 1) <> '' THEN trim(regexp_extract({both}, '{LABELS}=''([^'']+)''', 1))
 WHEN contains({name}, '_') AND split_part({name}, '_', 1) NOT IN ({quoted(K.GENERIC_METRIC_PREFIXES)}) THEN split_part({name}, '_', 1)
 ELSE 'system' END"""


STAGES: dict[str, str] = {}

STAGES["v_cases"] = f"""
SELECT {V.case_id_sql('k')} AS case_id, 'RE2-OB' AS dataset, {INJECT}::DOUBLE AS inject_time, 'svc3' AS gt_service,
       {V.fault_sql('k')} AS gt_fault, true AS has_logs, k <> 7 AS has_traces
FROM (SELECT DISTINCT event_id % 8 AS k FROM events)"""

STAGES["v_logs"] = f"""
SELECT {V.case_id_sql(V.CASE_OF_EVENT)} AS case_id, concat('svc', user_id % 12) AS service,
       CAST({EVENT_US} AS DOUBLE) / 1000000.0 AS ts, {duck(V.MESSAGE_SQL)} AS message, event_id AS seq
FROM events"""

STAGES["v_points"] = f"""
SELECT {V.case_id_sql(V.CASE_OF_EVENT)} AS case_id, {duck(V.METRIC_SQL)} AS metric_name,
       concat('case:', {duck(V.METRIC_SQL)}) AS query, CAST({EVENT_US} AS DOUBLE) / 1000000.0 AS ts,
       CAST({V.VALUE_SQL} AS DOUBLE) AS value, event_id AS seq
FROM events"""

STAGES["v_spans"] = f"""
SELECT {V.case_id_sql(V.CASE_OF_SPAN)} AS case_id, CAST(l_orderkey AS VARCHAR) AS trace_id,
       concat(l_orderkey, '_', r) AS span_id,
       CASE WHEN r > 1 THEN concat(l_orderkey, '_', r // 2) END AS parent_id,
       concat('svc', l_suppkey % 12) AS service, concat(l_linestatus, l_returnflag) AS operation,
       {SPAN_US} + r * 1000 AS start_us,
       CAST(l_quantity * 10000 * CASE WHEN l_suppkey % 12 = 3 AND {LATE} THEN 8 ELSE 1 END AS BIGINT) AS duration_us,
       CASE WHEN l_returnflag = 'R' AND l_suppkey % 12 = 3 AND {LATE} THEN 504 ELSE 200 END AS status,
       (l_returnflag = 'A' AND l_suppkey % 12 = 3 AND {LATE} AND l_tax > 0.06) AS logged_timeout,
       r AS seq
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# --- slices ---------------------------------------------------------------------------------
STAGES["p_logs"] = f"SELECT * FROM (SELECT *, {PHASE} AS phase FROM v_logs) WHERE phase IS NOT NULL"
STAGES["points"] = f"SELECT * FROM (SELECT *, {PHASE} AS phase FROM v_points) WHERE phase IS NOT NULL"
STAGES["lines"] = """
SELECT *, concat('[', CASE WHEN us % 1000000 = 0 THEN strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') END,
                 '+00:00] ', message) AS line,
       row_number() OVER (PARTITION BY case_id, phase, service ORDER BY ts, seq) - 1 AS line_no
FROM (SELECT *, CAST(round(ts * 1000000) AS BIGINT) AS us FROM p_logs)"""
STAGES["spans"] = f"""
SELECT s.*, s.status = 504 OR s.logged_timeout AS is_error,
       s.status = 504 OR s.logged_timeout AS is_timeout, t.phase, t.trace_start_us
FROM v_spans s JOIN (
  SELECT case_id, trace_id, trace_start_us, {PHASE} AS phase
  FROM (SELECT case_id, trace_id, min(start_us) AS trace_start_us, min(start_us) / 1000000.0 AS ts FROM v_spans GROUP BY ALL)
) t USING (case_id, trace_id) WHERE t.phase IS NOT NULL"""

# --- logs -----------------------------------------------------------------------------------
STAGES["signed"] = f"SELECT *, {tokens_sql(mask_sql('trim(line)'))} AS template FROM lines"
STAGES["base_templates"] = "SELECT DISTINCT case_id, template FROM signed WHERE phase = 'baseline'"
STAGES["annotated"] = f"""
SELECT s.*, b.template IS NULL AND s.template <> '' AS is_novel, {keyword_sql('lower(s.line)')} AS keyword,
       {any_of('lower(s.line)', K.PROBE_MARKS)} AS probe
FROM signed s LEFT JOIN base_templates b ON s.case_id = b.case_id AND s.template = b.template
WHERE s.phase = 'incident'"""
STAGES["cands"] = "SELECT * FROM annotated WHERE keyword IS NOT NULL OR is_novel"
STAGES["islands"] = f"""
SELECT *, max(CASE WHEN prev IS NULL OR line_no - prev > {K.CONTEXT_BEFORE + K.CONTEXT_AFTER + 1} THEN line_no END)
          OVER (PARTITION BY case_id, service ORDER BY line_no) AS window_id
FROM (SELECT *, lag(line_no) OVER (PARTITION BY case_id, service ORDER BY line_no) AS prev FROM cands)"""
STAGES["targets"] = """
SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY case_id, service, window_id) AS targets,
         row_number() OVER (PARTITION BY case_id, service, window_id ORDER BY keyword IS NULL, line_no) AS pick
  FROM islands) WHERE pick = 1"""
CONT = (
    "(trim(line) <> '' AND (starts_with(line, '  ') OR starts_with(line, chr(9)) OR "
    + " OR ".join(f"starts_with(lower(trim(line)), '{p}')" for p in K.STACK_PREFIXES)
    + " OR "
    + any_of("lower(trim(line))", K.STACK_MARKS)
    + "))"
)
STAGES["before_rows"] = f"""
SELECT case_id, service, target_no, -k AS k, line_no, line FROM (
  SELECT t.case_id, t.service, t.line_no AS target_no, a.line_no, a.line,
         row_number() OVER (PARTITION BY t.case_id, t.service, t.line_no ORDER BY a.line_no DESC) AS k
  FROM targets t JOIN annotated a ON a.case_id = t.case_id AND a.service = t.service AND a.line_no < t.line_no
  WHERE NOT a.probe) WHERE k <= {K.CONTEXT_BEFORE}"""
STAGES["after_all"] = f"""
SELECT *, {CONT} AS cont FROM (
  SELECT t.case_id, t.service, t.line_no AS target_no, a.line_no, a.line,
         row_number() OVER (PARTITION BY t.case_id, t.service, t.line_no ORDER BY a.line_no) AS k
  FROM targets t JOIN annotated a ON a.case_id = t.case_id AND a.service = t.service AND a.line_no > t.line_no
  WHERE NOT a.probe) WHERE k <= {K.CONTEXT_AFTER + K.CONTINUATION_EXTRA}"""
STAGES["after_rows"] = f"""
SELECT case_id, service, target_no, k, line_no, line FROM (
  SELECT *, min(CASE WHEN k > {K.CONTEXT_AFTER} AND NOT cont THEN k END)
            OVER (PARTITION BY case_id, service, target_no) AS stop_at FROM after_all)
WHERE stop_at IS NULL OR k < stop_at"""
STAGES["snips"] = f"""
SELECT t.case_id, t.service, t.line_no + 1 AS line_number, t.keyword, t.template, t.is_novel, t.line AS target_line,
       coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after,
       concat(coalesce(b.txt || {NL}, ''), '▶ [ERROR] ', t.line, coalesce({NL} || a.txt, '')) AS block
FROM targets t
LEFT JOIN (SELECT case_id, service, target_no, count(*) AS n, string_agg('  [ctx] ' || line, {NL} ORDER BY line_no) AS txt
           FROM before_rows GROUP BY ALL) b
  ON b.case_id = t.case_id AND b.service = t.service AND b.target_no = t.line_no
LEFT JOIN (SELECT case_id, service, target_no, count(*) AS n, string_agg('  [ctx] ' || line, {NL} ORDER BY line_no) AS txt
           FROM after_rows GROUP BY ALL) a
  ON a.case_id = t.case_id AND a.service = t.service AND a.target_no = t.line_no"""
STAGES["novels"] = """
SELECT case_id, service, count(*) AS total_lines, count(DISTINCT CASE WHEN is_novel THEN template END) AS novel_templates
FROM annotated GROUP BY ALL"""
STAGES["evidence"] = f"""
SELECT s.case_id, s.service, n.total_lines, n.novel_templates, s.snippets, s.infra_hits, s.silent_hits,
       greatest(1, length(s.txt) // 4) AS tokens, s.txt AS text
FROM (SELECT case_id, service, count(*) AS snippets,
             count(*) FILTER (WHERE {any_of('lower(target_line)', K.INFRA_PHRASES)}) AS infra_hits,
             count(*) FILTER (WHERE {any_of('lower(target_line)', K.SILENT_PHRASES)}) AS silent_hits,
             concat('--- Service: ', service, ' ---', {NL}, string_agg(block, {NL} || {NL} ORDER BY line_number)) AS txt
      FROM snips GROUP BY case_id, service) s JOIN novels n USING (case_id, service)"""
STAGES["ranked_ev"] = """
SELECT *, row_number() OVER w AS budget_rank, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS used
FROM evidence WINDOW w AS (PARTITION BY case_id ORDER BY snippets DESC, novel_templates DESC, service)"""
STAGES["kept"] = f"""
SELECT case_id, service, total_lines, novel_templates, snippets, infra_hits, silent_hits, budget_rank,
       used > {K.LOG_TOKEN_BUDGET} AS truncated,
       CASE WHEN used > {K.LOG_TOKEN_BUDGET} THEN left_over ELSE tokens END AS tokens,
       CASE WHEN used > {K.LOG_TOKEN_BUDGET} THEN concat(substr(text, 1, CAST(left_over * 4 AS BIGINT)), {MARK}) ELSE text END AS text
FROM (SELECT *, greatest(0, {K.LOG_TOKEN_BUDGET} - (used - tokens)) AS left_over,
             min(CASE WHEN used > {K.LOG_TOKEN_BUDGET} THEN budget_rank END) OVER (PARTITION BY case_id) AS first_over
      FROM ranked_ev)
WHERE first_over IS NULL OR budget_rank < first_over
   OR (budget_rank = first_over AND left_over > {K.MIN_TRUNCATED_TOKENS})"""

# --- metrics --------------------------------------------------------------------------------
STAGES["self_points"] = """
SELECT * EXCLUDE (i, n) FROM (
  SELECT p.*, row_number() OVER (PARTITION BY case_id, metric_name ORDER BY ts, seq) AS i,
         count(*) OVER (PARTITION BY case_id, metric_name) AS n
  FROM points p WHERE phase = 'incident' AND (case_id, metric_name) NOT IN
    (SELECT (case_id, metric_name) FROM points WHERE phase = 'baseline'))
WHERE i <= greatest(2, floor(n * 0.3))"""


def stats_sql(source: str) -> str:
    return f"""
SELECT m.*, d.mad FROM (
  SELECT case_id, metric_name, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, median(value) AS median
  FROM {source} GROUP BY ALL) m
JOIN (SELECT case_id, metric_name, median(abs(value - med)) AS mad FROM
       (SELECT *, median(value) OVER (PARTITION BY case_id, metric_name) AS med FROM {source}) GROUP BY ALL) d
USING (case_id, metric_name)"""


STAGES["base_points"] = "SELECT * FROM points WHERE phase = 'baseline'"
STAGES["basis"] = "SELECT * FROM base_points UNION ALL BY NAME SELECT * FROM self_points"
STAGES["base_stats"] = stats_sql("base_points")
STAGES["self_stats"] = stats_sql("self_points")
STAGES["ref_stats"] = stats_sql("basis")
STAGES["limits"] = f"""
SELECT case_id, service, arg_max(value, (phase = 'incident', metric_name, query)) AS memory_limit FROM (
  SELECT case_id, metric_name, query, phase, {metric_service_sql('metric_name', 'query')} AS service,
         arg_max(value, (ts, seq)) AS value
  FROM points WHERE {any_of('lower(metric_name)', K.LIMIT_MARKS)} GROUP BY ALL) WHERE value > 0 GROUP BY ALL"""
STAGES["slopes"] = """
SELECT case_id, metric_name,
       CASE WHEN count(*) < 2 OR max(ts) <= min(ts) THEN 0.0 ELSE coalesce(regr_slope(value, ts - t0), 0.0) END AS slope
FROM (SELECT *, avg(ts) OVER (PARTITION BY case_id, metric_name) AS t0 FROM points WHERE phase = 'incident')
GROUP BY ALL"""
STAGES["peaks"] = """
SELECT p.case_id, p.metric_name, max(p.query) AS query, s.mean, s.std, s.median, s.mad,
       arg_min(p.value, (-abs(p.value - s.mean), p.ts, p.seq)) AS peak
FROM points p JOIN ref_stats s USING (case_id, metric_name) WHERE p.phase = 'incident'
GROUP BY p.case_id, p.metric_name, s.mean, s.std, s.median, s.mad"""
STAGES["scored"] = f"""
SELECT *, greatest(abs(z), abs(robust_z)) AS divergence FROM (
  SELECT p.*, {any_of('lower(p.metric_name)', K.MEMORY_MARKS)} AS is_memory,
         {any_of('lower(p.metric_name)', K.LATENCY_MARKS)} AS is_latency,
         {metric_service_sql('p.metric_name', 'p.query')} AS service,
         (peak - mean) / greatest(std, eps) AS z, 0.6745 * (peak - median) / greatest(mad, eps) AS robust_z
  FROM (SELECT *, CASE WHEN mean <> 0 THEN greatest(1e-6, abs(mean) * 1e-4) ELSE 1e-4 END AS eps FROM peaks) p)"""
STAGES["evaluated"] = """
SELECT *, coalesce(time_to_oom < 300, false) OR coalesce(is_memory AND slope > dynamic AND (z > 1.5 OR robust_z > 1.5), false) AS is_oom_risk
FROM (
  SELECT s.*, CASE WHEN s.is_memory THEN l.slope END AS slope, m.memory_limit,
         CASE WHEN s.is_memory AND l.slope > 0 AND m.memory_limit <> 0 THEN greatest(0, m.memory_limit - s.peak) / l.slope END AS time_to_oom,
         greatest(10000, CASE WHEN mean > 0 THEN least(50000, abs(mean) * 0.05) ELSE 50000 END) AS dynamic,
         CASE WHEN mean = 0 OR std = 0 THEN 3.0 ELSE greatest(2.5, least(5.0, 3.0 * (1 + 0.25 * least(2.0, abs(std / mean))))) END AS tau
  FROM scored s LEFT JOIN slopes l USING (case_id, metric_name) LEFT JOIN limits m USING (case_id, service))"""
STAGES["alerts"] = """
SELECT *, CASE WHEN is_oom_risk OR divergence >= tau * 2.5 THEN 'CRITICAL' WHEN divergence >= tau * 1.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       is_latency AND (z > tau OR robust_z > tau) AS latency_anomaly
FROM evaluated WHERE divergence >= tau OR is_oom_risk"""
STAGES["top_alerts"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id
  ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, divergence DESC, metric_name) AS alert_rank
  FROM alerts) WHERE alert_rank <= {K.MAX_ALERTS}"""
MB = "slope / 1000000.0"
STAGES["alert_texts"] = f"""
SELECT *, concat('Spike to ', {fmt('peak', 2)}, ' (baseline μ=', {fmt('mean', 2)}, ', σ=', {fmt('std', 2)}, ', z=', {fmt('z', 2, True)},
   ', robust_z=', {fmt('robust_z', 2, True)}, ', τ=', {fmt('tau', 2)}, ')',
   CASE WHEN is_oom_risk THEN concat('; Steep memory slope +', {fmt(MB, 2)}, 'MB/s indicates OOM risk',
             CASE WHEN time_to_oom IS NOT NULL THEN concat(' (estimated TimeToOOM: ', {fmt('time_to_oom', 0)}, 's)') ELSE '' END)
        WHEN slope > 0 THEN concat('; Slope +', {fmt(MB, 2)}, 'MB/s') ELSE '' END) AS description,
  concat('- [', severity, '] Service ''', service, ''' - ', metric_name, ': value=', {fmt('peak', 2)}, ' (baseline μ=', {fmt('mean', 2)},
   ', z=', {fmt('z', 2, True)}, CASE WHEN slope <> 0 THEN concat(', slope=', {fmt(MB, 2, True)}, 'MB/s') ELSE '' END, ')',
   CASE WHEN is_oom_risk THEN ' [CRITICAL OOM RISK]' ELSE '' END,
   CASE WHEN time_to_oom IS NOT NULL THEN concat(' (TimeToOOM ~', {fmt('time_to_oom', 0)}, 's)') ELSE '' END) AS item
FROM top_alerts"""
STAGES["metric_ev"] = f"""
SELECT e.case_id, e.n AS metrics_evaluated, coalesce(t.n, 0) AS alerts, coalesce(a.has_oom, false) AS has_oom,
       coalesce(a.has_latency, false) AS has_latency,
       coalesce('### Metric Anomaly Alerts:' || {NL} || t.txt, 'No metric anomalies detected (Z-scores within normal distribution).') AS text
FROM (SELECT case_id, count(*) AS n FROM evaluated GROUP BY ALL) e
LEFT JOIN (SELECT case_id, bool_or(is_oom_risk) AS has_oom, bool_or(latency_anomaly) AS has_latency FROM alerts GROUP BY ALL) a USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS n, string_agg(item, {NL} ORDER BY alert_rank) AS txt FROM alert_texts GROUP BY ALL) t USING (case_id)"""

# --- traces ---------------------------------------------------------------------------------
STAGES["inc_spans"] = "SELECT * FROM spans WHERE phase = 'incident'"
STAGES["links"] = """
SELECT c.*, p.span_id IS NOT NULL AS has_parent, p.service AS parent_service, p.duration_us AS parent_duration_us,
       p.is_timeout AS parent_timeout, p.seq AS parent_seq
FROM inc_spans c LEFT JOIN inc_spans p ON c.case_id = p.case_id AND c.trace_id = p.trace_id AND c.parent_id = p.span_id"""
STAGES["edges"] = """
SELECT case_id, parent_service AS caller, service AS callee, min({'a': trace_start_us, 'b': trace_id, 'c': seq}) AS first_call FROM links
WHERE has_parent AND parent_service <> service GROUP BY ALL"""
STAGES["turns"] = "SELECT case_id, caller, min(first_call) AS turn FROM edges GROUP BY ALL"
STAGES["depths"] = """
SELECT case_id, trace_id, span_id, 0 AS depth, [seq] AS path FROM links WHERE NOT has_parent
UNION ALL
SELECT c.case_id, c.trace_id, c.span_id, d.depth + 1, list_append(d.path, c.seq)
FROM links c JOIN depths d ON c.case_id = d.case_id AND c.trace_id = d.trace_id AND c.parent_id = d.span_id"""
STAGES["selfs"] = """
SELECT s.case_id, s.trace_id, s.span_id, greatest(0.0, s.duration_us / 1000.0 - coalesce(k.ms, 0)) AS self_ms
FROM inc_spans s LEFT JOIN (SELECT case_id, trace_id, parent_id, sum(duration_us / 1000.0) AS ms FROM links WHERE has_parent GROUP BY ALL) k
  ON s.case_id = k.case_id AND s.trace_id = k.trace_id AND s.span_id = k.parent_id"""
STAGES["p99s"] = f"""
SELECT case_id, service, operation, max(n) AS spans, max(ms) FILTER (WHERE i = greatest(1, floor(n * 0.99))) AS p99_ms
FROM (SELECT case_id, service, operation, duration_us / 1000.0 AS ms,
             row_number() OVER (PARTITION BY case_id, service, operation ORDER BY duration_us) AS i,
             count(*) OVER (PARTITION BY case_id, service, operation) AS n
      FROM spans WHERE phase = 'baseline') WHERE n >= {K.BASELINE_MIN_SPANS} GROUP BY ALL"""
STAGES["facts"] = f"""
SELECT l.*, d.depth, d.path, s.self_ms, p.p99_ms,
       coalesce(s.self_ms > greatest(50.0, p.p99_ms * 2.0), false) AS is_bottleneck,
       l.has_parent AND coalesce(l.parent_timeout, false)
         AND (l.duration_us >= 0.6 * l.parent_duration_us OR s.self_ms >= 0.5 * (l.parent_duration_us / 1000.0)) AS is_timeout_child
FROM links l JOIN depths d USING (case_id, trace_id, span_id) JOIN selfs s USING (case_id, trace_id, span_id)
LEFT JOIN p99s p ON l.case_id = p.case_id AND l.service = p.service AND l.operation = p.operation"""
STAGES["leafs"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, trace_id
            ORDER BY depth DESC, class, CASE WHEN class = 1 THEN parent_seq ELSE seq END, seq) AS pick
  FROM (SELECT *, CASE WHEN is_error THEN 0 WHEN is_timeout_child THEN 1 ELSE 2 END AS class
        FROM facts WHERE is_error OR is_timeout_child OR is_bottleneck)) WHERE pick = 1"""
STAGES["culprits"] = """
SELECT v.case_id, v.service AS culprit_service, v.votes, s.trace_id AS culprit_trace_id, s.span_id AS culprit_span_id,
       s.service AS span_service, s.operation AS span_operation, s.duration_us AS span_duration_us,
       s.status AS span_status_code, s.depth AS leaf_depth
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, seen) AS pick FROM
        (SELECT case_id, service, count(*) * 3 AS votes, min((trace_start_us, trace_id)) AS seen FROM leafs GROUP BY ALL)) WHERE pick = 1) v
JOIN (SELECT * FROM (SELECT * EXCLUDE (pick), row_number() OVER (PARTITION BY case_id ORDER BY depth DESC, trace_start_us, trace_id) AS pick
        FROM leafs) WHERE pick = 1) s USING (case_id)"""
STAGES["trace_ev"] = """
SELECT t.*, c.* EXCLUDE (case_id) FROM (
  SELECT case_id, count(*) AS spans, count(*) FILTER (WHERE is_error) AS error_spans,
         count(*) FILTER (WHERE is_bottleneck) AS bottlenecks, min(CASE WHEN NOT has_parent THEN service END) AS root_service,
         count(DISTINCT trace_id) AS traces
  FROM facts GROUP BY ALL) t LEFT JOIN culprits c USING (case_id)"""
STAGES["failing"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY trace_start_us, trace_id) AS trace_rank
  FROM (SELECT DISTINCT case_id, trace_id, trace_start_us FROM facts WHERE is_error OR is_bottleneck))
WHERE trace_rank <= {K.MAX_CALL_TREES}"""
STAGES["marks"] = """
SELECT f.case_id, f.trace_id, f.trace_rank,
       (SELECT arg_min(l2.span_id, (-l2.depth, f2.trace_rank)) FROM failing f2 JOIN leafs l2 USING (case_id, trace_id)
        WHERE f2.case_id = f.case_id AND f2.trace_rank <= f.trace_rank) AS marked_id
FROM failing f"""
STAGES["tree_lines"] = f"""
SELECT case_id, trace_id, trace_rank, []::BIGINT[] AS path, concat('Trace ', trace_id, ':') AS line FROM failing
UNION ALL
SELECT f.case_id, f.trace_id, m.trace_rank, f.path,
       concat(repeat('  ', f.depth), CASE WHEN f.depth > 0 THEN '↳ ' ELSE '' END, f.service, ':', f.operation, ' (',
              {fmt('f.duration_us / 1000.0', 1)}, 'ms)',
              CASE WHEN f.is_error THEN concat(' [ERROR ', f.status, ']') WHEN f.is_bottleneck THEN ' [LATENCY BOTTLENECK]' ELSE '' END,
              CASE WHEN f.span_id = m.marked_id THEN ' <--- [LEAF CULPRIT]' ELSE '' END)
FROM facts f JOIN marks m USING (case_id, trace_id)"""
STAGES["trees"] = f"""
SELECT case_id, string_agg(t, {NL} || {NL} ORDER BY trace_rank) AS tree FROM (
  SELECT case_id, trace_rank, string_agg(line, {NL} ORDER BY path) AS t FROM tree_lines GROUP BY ALL) GROUP BY ALL"""
STAGES["trace_texts"] = f"""
SELECT e.case_id, CASE WHEN error_spans = 0 AND bottlenecks = 0
  THEN concat('Evaluated ', traces, ' distributed traces. No span error codes or anomalies detected.')
  ELSE concat('### Distributed Trace Analysis:', {NL}, '- Total Traces: ', traces, ', Failing Spans: ', error_spans, ', Latency Bottlenecks: ', bottlenecks,
    CASE WHEN culprit_service IS NOT NULL THEN concat({NL}, '- Isolated Culprit Service: ''', culprit_service, '''') ELSE '' END,
    CASE WHEN span_service IS NOT NULL THEN concat({NL}, '- Deepest Leaf Culprit Span: ', span_service, ':', span_operation, ' (status=', span_status_code,
      ', duration=', {fmt('span_duration_us / 1000.0', 1)}, 'ms, depth=', leaf_depth, ')') ELSE '' END,
    CASE WHEN tree IS NOT NULL THEN concat({NL}, {NL}, 'Call Hierarchy DAG:', {NL}, tree) ELSE '' END) END AS text
FROM trace_ev e LEFT JOIN trees USING (case_id)"""

# --- fusion ---------------------------------------------------------------------------------
STAGES["modes"] = f"SELECT unnest([{quoted(K.MODES)}]) AS mode"
STAGES["case_modes"] = "SELECT case_id, mode FROM v_cases, modes"
STAGES["log_scores"] = "SELECT case_id, service, snippets * 1.0 + least(novel_templates, 10) * 2.5 AS score, 'LOGS' AS signal, 0 AS s, budget_rank AS r FROM kept"
STAGES["metric_scores"] = """
SELECT case_id, service, sum(CASE WHEN is_oom_risk THEN 6.0 WHEN severity = 'CRITICAL' THEN 4.5 WHEN severity = 'HIGH' THEN 3.0 * 1.2 ELSE 3.0 END) AS score,
       'METRICS' AS signal, 1 AS s, min(alert_rank) AS r FROM top_alerts GROUP BY ALL"""
STAGES["trace_scores"] = """
SELECT case_id, culprit_service AS service, 5.0 + CASE WHEN leaf_depth > 0 THEN 2.0 ELSE 0.0 END AS score, 'TRACES' AS signal, 2 AS s, 0 AS r
FROM trace_ev WHERE culprit_service IS NOT NULL"""
STAGES["mode_scores"] = """
SELECT x.*, mode FROM (SELECT * FROM log_scores UNION ALL SELECT * FROM metric_scores UNION ALL SELECT * FROM trace_scores) x, modes
WHERE signal = 'LOGS' OR (signal = 'METRICS' AND mode IN ('logs-metrics', 'fusion')) OR (signal = 'TRACES' AND mode IN ('logs-traces', 'fusion'))"""
STAGES["base_scores"] = """
SELECT case_id, mode, service, CAST(sum(score) AS DOUBLE) AS base, bool_or(signal = 'LOGS') AS in_logs, bool_or(signal = 'METRICS') AS in_metrics,
       bool_or(signal = 'TRACES') AS in_traces, min((s, r)) AS ord
FROM mode_scores GROUP BY ALL"""
STAGES["live_edges"] = """
SELECT a.case_id, a.mode, e.caller, e.callee FROM base_scores a JOIN edges e ON a.case_id = e.case_id AND a.service = e.caller
JOIN base_scores b ON b.case_id = a.case_id AND b.mode = a.mode AND b.service = e.callee
WHERE a.mode IN ('logs-traces', 'fusion')"""
STAGES["propagated"] = """
SELECT b.*, CASE WHEN d.caller IS NOT NULL THEN (base + 2.0 * coalesce(k.bef, 0)) * 0.6 + 2.0 * coalesce(k.aft, 0)
            ELSE base + 2.0 * (coalesce(k.bef, 0) + coalesce(k.aft, 0)) END AS score
FROM base_scores b
LEFT JOIN (SELECT DISTINCT case_id, mode, caller FROM live_edges) d ON d.case_id = b.case_id AND d.mode = b.mode AND d.caller = b.service
LEFT JOIN (SELECT case_id, mode, callee, count(*) FILTER (WHERE o.turn IS NULL OR t.turn < o.turn) AS bef, count(*) FILTER (WHERE t.turn >= o.turn) AS aft
           FROM live_edges e JOIN turns t USING (case_id, caller) LEFT JOIN turns o ON o.case_id = e.case_id AND o.caller = e.callee GROUP BY case_id, mode, callee) k ON k.case_id = b.case_id AND k.mode = b.mode AND k.callee = b.service"""
STAGES["agreed"] = """
SELECT * EXCLUDE (score), score * CASE signals WHEN 2 THEN 1.35 WHEN 3 THEN 1.75 ELSE 1.0 END AS score
FROM (SELECT *, in_logs::INT + in_metrics::INT + in_traces::INT AS signals FROM propagated)"""
STAGES["ranking"] = "SELECT *, row_number() OVER (PARTITION BY case_id, mode ORDER BY round(score, 9) DESC, ord, service) AS rank FROM agreed"
STAGES["signals"] = """
SELECT c.case_id, c.mode, coalesce(l.n, 0) AS log_services, coalesce(l.snippets, 0) AS snippets, coalesce(l.novel, 0) AS novel_templates,
       coalesce(l.infra, 0) AS infra_hits, coalesce(l.silent, 0) AS silent_hits,
       CASE WHEN um THEN coalesce(a.n, 0) ELSE 0 END AS alerts, CASE WHEN um THEN coalesce(a.urgent, 0) ELSE 0 END AS urgent_oom,
       CASE WHEN um THEN coalesce(a.oom, 0) ELSE 0 END AS oom_alerts, a.divergence AS top_divergence,
       um AND coalesce(m.has_oom, false) AS has_oom, um AND coalesce(m.has_latency, false) AS has_latency,
       CASE WHEN ut THEN coalesce(t.error_spans, 0) ELSE 0 END AS error_spans, CASE WHEN ut THEN coalesce(t.bottlenecks, 0) ELSE 0 END AS bottlenecks,
       CASE WHEN ut THEN coalesce(t.leaf_depth, 0) ELSE 0 END AS leaf_depth,
       CASE WHEN ut THEN coalesce(t.traces, 0) ELSE 0 END AS traces, CASE WHEN ut THEN coalesce(t.spans, 0) ELSE 0 END AS spans,
       CASE WHEN ut THEN t.span_service END AS span_service, CASE WHEN ut THEN t.span_operation END AS span_operation,
       CASE WHEN ut THEN t.span_status_code END AS span_status_code, a.top_service AS peak_service, a.top_metric, a.top_z
FROM (SELECT *, mode IN ('logs-metrics', 'fusion') AS um, mode IN ('logs-traces', 'fusion') AS ut FROM case_modes) c
LEFT JOIN (SELECT case_id, count(*) AS n, sum(snippets) AS snippets, sum(novel_templates) AS novel, sum(infra_hits) AS infra, sum(silent_hits) AS silent
           FROM kept GROUP BY ALL) l USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE is_oom_risk) AS oom,
                  count(*) FILTER (WHERE time_to_oom <> 0 AND time_to_oom < 180) AS urgent, arg_min(divergence, alert_rank) AS divergence,
                  arg_min(service, alert_rank) AS top_service, arg_min(metric_name, alert_rank) AS top_metric, arg_min(z, alert_rank) AS top_z
           FROM top_alerts GROUP BY ALL) a USING (case_id)
LEFT JOIN metric_ev m USING (case_id)
LEFT JOIN trace_ev t USING (case_id)"""
STAGES["likelihoods"] = """
SELECT *, 0.1 + CASE WHEN alerts > 0 AND has_oom THEN 8.0 ELSE 0 END + CASE WHEN alerts > 0 AND has_oom AND urgent_oom > 0 THEN 4.0 ELSE 0 END AS ec1,
  0.1 + CASE WHEN alerts > 0 AND has_latency THEN 6.5 ELSE 0 END + CASE WHEN error_spans = 0 AND bottlenecks > 0 THEN 4.0 ELSE 0 END AS ec2,
  0.1 + CASE WHEN error_spans >= 2 THEN 7.0 + least(4.0, leaf_depth * 1.5) WHEN error_spans = 1 THEN 3.0 ELSE 0 END AS ec3,
  0.05 + CASE WHEN snippets > 0 THEN silent_hits * 3.0 ELSE 0 END
       + CASE WHEN snippets = 0 AND alerts = 0 AND error_spans = 0 AND bottlenecks = 0 THEN 4.0 ELSE 0 END AS ec4,
  0.1 + CASE WHEN snippets > 0 THEN infra_hits * 3.0 ELSE 0 END AS ec5,
  0.1 + CASE WHEN snippets > 0 THEN 3.5 + least(4.5, novel_templates * 1.5) ELSE 0 END AS code_bug
FROM signals"""
STAGES["categories"] = f"""
SELECT *, CASE WHEN best <= 0.2 THEN '{K.UNKNOWN_CATEGORY}' WHEN ec1 = best THEN '{K.EC1}' WHEN ec2 = best THEN '{K.EC2}'
  WHEN ec3 = best THEN '{K.EC3}' WHEN ec4 = best THEN '{K.EC4}' WHEN ec5 = best THEN '{K.EC5}' ELSE '{K.CODE_BUG}' END AS category
FROM (SELECT *, greatest(ec1, ec2, ec3, ec4, ec5, code_bug) AS best FROM likelihoods)"""
STAGES["tops"] = """
SELECT c.*, coalesce(a.service, 'unknown') AS top_service, a.score AS top_score, b.score AS runner_score,
       coalesce(a.in_logs, false) AS top_in_logs, coalesce(a.in_metrics, false) AS top_in_metrics, coalesce(a.in_traces, false) AS top_in_traces
FROM categories c LEFT JOIN ranking a ON a.case_id = c.case_id AND a.mode = c.mode AND a.rank = 1
LEFT JOIN ranking b ON b.case_id = c.case_id AND b.mode = c.mode AND b.rank = 2"""
STAGES["certain"] = """
SELECT *, CASE WHEN alerts > 0 THEN least(0.95, greatest(0.40, top_divergence / 8.0)) ELSE 0 END AS c_m,
  CASE WHEN error_spans > 0 OR bottlenecks > 0 THEN least(0.95, greatest(0.50, 0.45 + 0.15 * leaf_depth)) ELSE 0 END AS c_t,
  CASE WHEN snippets > 0 THEN least(0.90, greatest(0.35, 0.35 + 0.10 * least(5, snippets))) ELSE 0 END AS c_l,
  CASE WHEN runner_score IS NULL THEN 1.0 WHEN top_score > 0 THEN greatest(0.1, least(1.0, (top_score - runner_score) / top_score)) ELSE 0.2 END AS margin
FROM tops"""
STAGES["agreeing"] = """
SELECT *, (top_in_metrics AND c_m > 0)::INT + (top_in_traces AND c_t > 0)::INT + (top_in_logs AND c_l > 0)::INT AS agreeing,
  1.0 - (CASE WHEN top_in_metrics AND c_m > 0 THEN 1.0 - c_m ELSE 1.0 END * CASE WHEN top_in_traces AND c_t > 0 THEN 1.0 - c_t ELSE 1.0 END
        * CASE WHEN top_in_logs AND c_l > 0 THEN 1.0 - c_l ELSE 1.0 END) AS support
FROM certain"""
STAGES["diagnosis"] = """
SELECT *, CASE WHEN agreeing > 0 THEN greatest(0.50, least(0.95, round(CAST(support * (0.65 + 0.35 * margin) AS DOUBLE), 2))) ELSE 0.50 END AS confidence,
  CASE WHEN agreeing >= 2 THEN 'FUSION' WHEN top_in_traces THEN 'TRACES' WHEN top_in_metrics THEN 'METRICS' WHEN top_in_logs THEN 'LOGS' ELSE 'FUSION' END AS primary_signal
FROM agreeing"""
STAGES["insights"] = f"""
SELECT d.*, CASE WHEN log_services = 0 THEN 'No log evidence evaluated.'
    WHEN k.snippets > 0 THEN concat('Isolated ', k.snippets, ' error snippet(s) in ''', d.top_service, ''' with ', k.novel_templates, ' novel Drain3 template(s).')
    ELSE concat('Identified ', d.snippets, ' error snippet(s) across ', log_services, ' microservices.') END AS logs_insight,
  CASE WHEN alerts = 0 THEN 'Metrics evaluated within normal bounds (no Z-score anomalies).'
    WHEN o.n > 0 THEN concat('Detected ', o.n, ' anomaly alert(s) for ''', d.top_service, ''': ', o.metric_name, ' (z=', {fmt('o.z', 2, True)}, ')',
         CASE WHEN o.is_oom_risk THEN ' [Steep memory slope indicates OOM risk]' ELSE '' END, '.')
    ELSE concat('Peak anomaly detected at ''', peak_service, ''': ', top_metric, ' (z=', {fmt('top_z', 2, True)}, ').') END AS metrics_insight,
  CASE WHEN error_spans = 0 THEN 'Distributed traces show no failing spans or HTTP/gRPC error tags.'
    WHEN span_service IS NOT NULL THEN concat('DFS DAG traversal isolated deepest leaf culprit at ''', span_service, ':', span_operation,
         ''' (depth=', leaf_depth, ', status=', span_status_code, ').')
    ELSE concat('Encountered ', error_spans, ' failing span(s) across call graphs.') END AS traces_insight
FROM diagnosis d LEFT JOIN kept k ON k.case_id = d.case_id AND k.service = d.top_service
LEFT JOIN (SELECT case_id, service, count(*) AS n, arg_min(metric_name, alert_rank) AS metric_name, arg_min(z, alert_rank) AS z,
                  arg_min(is_oom_risk, alert_rank) AS is_oom_risk FROM top_alerts GROUP BY ALL) o
  ON o.case_id = d.case_id AND o.service = d.top_service"""
STAGES["told"] = """
SELECT *, concat('Multi-signal correlation localized root cause to ''', top_service, ''' under category ', category, '. Cross-modal consensus verified across ',
    agreeing, ' telemetry modality/modalities (Primary: ', primary_signal, ').',
    CASE WHEN contains(traces_insight, 'deepest leaf') THEN ' Trace call hierarchy confirmed this service is the downstream origin rather than an innocent caller.' ELSE '' END,
    CASE WHEN contains(metrics_insight, 'OOM risk') THEN ' Metric time series confirmed memory consumption climbing at an unsustainable slope.' ELSE '' END) AS reasoning
FROM insights"""
STAGES["candidates3"] = """
SELECT c.case_id, c.mode, coalesce(string_agg(r.service, ';' ORDER BY r.rank), 'unknown') AS culprits,
       min(CASE WHEN r.service = 'svc3' THEN r.rank END) AS place
FROM case_modes c LEFT JOIN ranking r ON r.case_id = c.case_id AND r.mode = c.mode AND r.rank <= 3 GROUP BY ALL"""
STAGES["scores"] = f"""
SELECT *, {bucket_sql('top1_hit', 'top3_hit', 'fault_match')} AS error_bucket FROM (
  SELECT d.case_id, d.mode, c.gt_service AS ground_truth_service, d.top_service AS predicted_service, k.culprits AS ranked_candidates,
         c.gt_fault AS ground_truth_fault, d.category AS predicted_category, coalesce(k.place = 1, false) AS top1_hit, k.place IS NOT NULL AS top3_hit,
         coalesce(1.0 / k.place, 0.0) AS mrr, d.category = {fault_category_sql('c.gt_fault')} AS fault_match, d.confidence
  FROM diagnosis d JOIN v_cases c USING (case_id) JOIN candidates3 k USING (case_id, mode))"""

# --- context --------------------------------------------------------------------------------
STAGES["topology"] = f"""
SELECT case_id, concat('### Service Dependency Graph (Caller -> Callees):', {NL}, string_agg(concat('- ', caller, ' ➔ [', c, ']'), {NL} ORDER BY caller)) AS topology
FROM (SELECT case_id, caller, string_agg(callee, ', ' ORDER BY callee) AS c FROM edges GROUP BY ALL) GROUP BY case_id"""
STAGES["parts"] = f"""
SELECT c.case_id, c.mode, concat('### Incident Reference ID: INC-', upper(substr(sha256(c.case_id), 1, 8))) AS header,
       CASE WHEN c.mode IN ('logs-traces', 'fusion') THEN CASE WHEN p.topology IS NULL THEN t.text ELSE concat(p.topology, {NL}, {NL}, t.text) END END AS tr,
       CASE WHEN c.mode IN ('logs-metrics', 'fusion') THEN m.text END AS me, l.txt AS lo
FROM case_modes c LEFT JOIN trace_texts t USING (case_id) LEFT JOIN topology p USING (case_id) LEFT JOIN metric_ev m USING (case_id)
LEFT JOIN (SELECT case_id, string_agg(text, {NL} || {NL} ORDER BY snippets DESC, budget_rank) AS txt FROM kept GROUP BY ALL) l USING (case_id)"""
STAGES["cut"] = f"""
SELECT *, {truncate_sql('tr', "greatest(250, least(greatest(1, length(tr) // 3), 891))")} AS trace_section,
       {truncate_sql('me', "greatest(200, least(greatest(1, length(me) // 3), 693))")} AS metric_section
FROM parts"""
STAGES["sections"] = f"""
SELECT case_id, mode, header, trace_section, metric_section,
       concat('### Extracted Log Evidence (Drain3 Novel Templates & Asymmetric Context):', {NL}, {truncate_sql('lo', 'room')}) AS log_section
FROM (SELECT *, greatest(200, 2100 - greatest(1, length(concat_ws({NL} || {NL}, header, trace_section, metric_section)) // 3) - 80) AS room FROM cut)
WHERE lo IS NOT NULL
UNION ALL SELECT case_id, mode, header, trace_section, metric_section, NULL FROM cut WHERE lo IS NULL"""
CLOSING = K.CONTEXT_CLOSING.lstrip("\n")
STAGES["contexts"] = f"""
SELECT case_id, mode, {truncate_sql('whole', '2100')} AS context,
       coalesce(greatest(1, length(trace_section) // 3), 0) AS trace_tokens, coalesce(greatest(1, length(metric_section) // 3), 0) AS metric_tokens,
       coalesce(greatest(1, length(log_section) // 3), 0) AS logs_tokens
FROM (SELECT *, concat_ws({NL} || {NL}, header, trace_section, metric_section, log_section, {NL} || '{CLOSING}') AS whole FROM sections)"""


def oracle(query: str) -> str:
    """Query preceded by the stages it needs; stages are declared in dependency order."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in STAGES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(STAGES[name])

    visit(query)
    if not wanted:
        return query
    body = ",\n".join(f"{n} AS ({STAGES[n]})" for n in STAGES if n in wanted)
    own = query.strip()
    if own.startswith("WITH "):
        return f"WITH RECURSIVE {body},\n{own[5:]}"
    return f"WITH RECURSIVE {body}\n{own}"
