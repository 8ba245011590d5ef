"""Log evidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.operators import templates as T
from faultlens.operators import windows as W
from faultlens.plans.materialize import scratch_path
from faultlens.sources.results import read_templates, write_templates
from queries.common import investigation

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


HEAD = "CASE WHEN regexp_matches({0}[1], '\\p{{Nd}}') THEN '<*>' ELSE {0}[1] END"


def _clustered(source: str, name: str, rounds: int = 4) -> str:
    """Stages that cluster `source`(case_id, template): {name} has (case_id, source, template).

    Rounds without a similar pair change nothing, so there may be more of them than needed.
    """
    need = "greatest(1, CAST(ceil(0.4 * len(w) - 1e-9) AS BIGINT))"
    same = "len(list_filter(list_zip(a.w, b.w), lambda x: x[1] = x[2] AND x[1] <> '<*>'))"
    stretch = "[w[1:m], w[(width - m) // 2 + 1:(width - m) // 2 + m], w[width - m + 1:]]"
    out = [f"{name}_m0 AS (SELECT DISTINCT case_id, template AS source, template FROM {source})"]
    for r in range(rounds + 1):
        if r == 0:
            parts = ", ".join(f"(a.s[{i}] = b.s[{i}] AND NOT list_contains(a.s[{i}], '<*>'))" for i in (1, 2, 3))
            linked = parts.replace("), (", ") OR (")
        else:
            linked = f"{same} >= a.m"
        n, p = f"{name}_{r}", f"{name}_m{r}"
        out += [
            f"{n}_w AS (SELECT DISTINCT case_id, template, string_split(template, ' ') AS w FROM {p})",
            f"{n}_l AS (SELECT *, len(w) AS width, {HEAD.format('w')} AS head, {need} AS m FROM {n}_w)",
            f"{n}_n AS (SELECT *, {stretch} AS s FROM {n}_l)",
            f"""{n}_e AS (SELECT a.case_id, a.template AS a, b.template AS b FROM {n}_n a JOIN {n}_n b
                ON a.case_id = b.case_id AND a.width = b.width AND a.head = b.head AND a.template <> b.template WHERE {linked})""",
            f"{n}_r AS (SELECT case_id, template AS a, template AS b FROM {n}_w UNION SELECT r.case_id, r.a, e.b FROM {n}_r r JOIN {n}_e e ON r.case_id = e.case_id AND r.b = e.a)",
            f"{n}_c AS (SELECT case_id, a AS template, min(b) AS root FROM {n}_r GROUP BY ALL)",
            f"""{n}_p AS (SELECT case_id, root, place, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS word FROM (
                SELECT c.case_id, c.root, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM {n}_c c JOIN {n}_w USING (case_id, template)) GROUP BY ALL)""",
            f"{n}_t AS (SELECT case_id, root, string_agg(word, ' ' ORDER BY place) AS merged FROM {n}_p GROUP BY ALL)",
            f"""{name}_m{r + 1} AS (SELECT m.case_id, m.source, t.merged AS template FROM {p} m JOIN {n}_c c ON m.case_id = c.case_id AND m.template = c.template
                JOIN {n}_t t ON t.case_id = c.case_id AND t.root = c.root)""",
        ]
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {name}_m{rounds + 1})"])


MINED = f"""base_signatures AS (SELECT DISTINCT case_id, template FROM signed WHERE phase = 'baseline' AND template <> ''),
{_clustered("base_signatures", "based")},
mined AS (SELECT case_id, template, count(*) AS signatures FROM based GROUP BY ALL)"""

WIDENED = f"""{MINED},
asked AS (SELECT DISTINCT case_id, template AS source, string_split(template, ' ') AS w FROM signed WHERE phase = 'incident' AND template <> ''),
covering AS (
  SELECT a.case_id, a.source, m.template, row_number() OVER (PARTITION BY a.case_id, a.source
    ORDER BY len(list_filter(string_split(m.template, ' '), lambda x: x <> '<*>')) DESC, m.template) AS k
  FROM asked a JOIN mined m ON a.case_id = m.case_id AND len(a.w) = len(string_split(m.template, ' '))
    AND {HEAD.format('a.w')} = {HEAD.format("string_split(m.template, ' ')")}
  WHERE len(list_filter(list_zip(string_split(m.template, ' '), a.w), lambda x: x[1] <> '<*>' AND x[1] <> x[2])) = 0),
covered AS (SELECT case_id, source, template FROM covering WHERE k = 1),
open_nodes AS (SELECT case_id, template FROM mined UNION SELECT case_id, source FROM asked ANTI JOIN covered USING (case_id, source)),
{_clustered("open_nodes", "widened")},
named AS (SELECT * FROM covered UNION ALL SELECT w.case_id, w.source, w.template FROM widened w JOIN (FROM asked ANTI JOIN covered USING (case_id, source)) USING (case_id, source))"""


@register(f"WITH {MINED} SELECT * FROM mined")
def mine_templates(spark, sf):
    return T.mine_templates(investigation(spark, sf).lines)


@register(
    f"""WITH {WIDENED} SELECT s.case_id, s.service, s.line_no, coalesce(n.template, '') AS template, s.template <> '' AND m.template IS NULL AS is_novel
        FROM signed s LEFT JOIN named n ON n.case_id = s.case_id AND n.source = s.template
        LEFT JOIN mined m ON m.case_id = n.case_id AND m.template = n.template WHERE s.phase = 'incident'"""
)
def classify_lines(spark, sf):
    return T.classify_lines(investigation(spark, sf).lines).select("case_id", "service", "line_no", "template", "is_novel")


@register("SELECT case_id, phase, template, count(*) AS lines FROM signed WHERE template <> '' GROUP BY ALL")
def signature_templates(spark, sf):
    return L.signature_templates(investigation(spark, sf).lines)


@register("SELECT case_id, service, line_no, template, is_novel FROM annotated")
def flag_novel(spark, sf):
    return investigation(spark, sf).annotated.select("case_id", "service", "line_no", "template", "is_novel")


@register(
    """WITH one AS (SELECT min(case_id) AS c FROM v_cases), saved AS (SELECT DISTINCT template FROM signed, one WHERE phase = 'baseline' AND case_id <> c)
       SELECT a.case_id, service, line_no, a.template,
         CASE WHEN a.case_id = c THEN a.template <> '' AND s.template IS NULL ELSE is_novel END AS is_novel
       FROM annotated a CROSS JOIN one LEFT JOIN saved s ON s.template = a.template"""
)
def saved_baseline(spark, sf):
    # One case comes without calm lines and is held against the saved templates of the others.
    inv = investigation(spark, sf)
    one = inv.cases.agg(F.min("case_id")).first()[0]
    path = scratch_path(spark, "templates")
    calm = inv.labelled_logs.filter((F.col("phase") == "baseline") & (F.col("case_id") != one))
    write_templates(L.with_signatures(W.as_lines(calm)), path)
    logs = inv.raw_logs.join(inv.cases.select("case_id", "inject_time"), "case_id")
    logs = logs.filter((F.col("case_id") != one) | (F.col("ts") >= F.col("inject_time"))).drop("inject_time")
    run = replace(inv, raw_logs=logs, saved_templates=read_templates(spark, path))
    return run.annotated.select("case_id", "service", "line_no", "template", "is_novel")


RUN = "concat('run_', lpad(CAST(user_id AS STRING), 6, '0'))"


@register(
    f"""WITH r AS (SELECT {RUN.replace('STRING', 'VARCHAR')} AS run_id, event_id, user_id FROM events),
     ok AS (SELECT DISTINCT run_id FROM r WHERE user_id % 3 <> 0 ORDER BY run_id DESC LIMIT 3)
     SELECT run_id, event_id FROM r WHERE run_id IN (SELECT run_id FROM ok)"""
)
def choose_baseline(spark, sf):
    from queries.common import events

    runs = events(spark, sf).selectExpr(
        f"{RUN} AS run_id", "event_id", "CASE WHEN user_id % 3 <> 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status"
    )
    return L.choose_baseline(runs).select("run_id", "event_id")


@register("SELECT case_id, service, line_no, keyword, is_novel FROM cands")
def error_candidates(spark, sf):
    return L.error_candidates(investigation(spark, sf).annotated).select("case_id", "service", "line_no", "keyword", "is_novel")


@register("SELECT * FROM novels")
def novel_counts(spark, sf):
    return L.novel_counts(investigation(spark, sf).annotated)


@register("SELECT case_id, service, line_no, window_id FROM islands")
def merge_windows(spark, sf):
    return investigation(spark, sf).log_windows.select("case_id", "service", "line_no", "window_id")


@register("SELECT case_id, service, window_id, targets, line_no, keyword, is_novel, line FROM targets")
def primary_target(spark, sf):
    return investigation(spark, sf).targets.select(
        "case_id", "service", "window_id", "targets", "line_no", "keyword", "is_novel", "line"
    )


@register("SELECT * FROM before_rows")
def context_before(spark, sf):
    inv = investigation(spark, sf)
    return L.context_before(inv.targets, inv.positioned, lines=inv.incident_lines)


@register("SELECT * FROM after_rows")
def context_after(spark, sf):
    inv = investigation(spark, sf)
    return L.context_after(inv.targets, inv.positioned, lines=inv.incident_lines)


@register(
    """SELECT t.case_id, t.service, t.line_no AS target_no, a.line_no - t.line_no AS k, a.line_no, a.line
       FROM targets t JOIN annotated a ON a.case_id = t.case_id AND a.service = t.service
        AND a.line_no BETWEEN t.line_no - 3 AND t.line_no + 7 AND a.line_no <> t.line_no"""
)
def context_plain(spark, sf):
    inv = investigation(spark, sf)
    return L.context_plain(inv.targets, inv.incident_lines)


@register("SELECT case_id, service, line_number, keyword, template, is_novel, target_line, n_before, n_after, block FROM snips")
def snippets(spark, sf):
    return investigation(spark, sf).snippets.select(
        "case_id", "service", "line_number", "keyword", "template", "is_novel", "target_line",
        F.size("context_before").alias("n_before"), F.size("context_after").alias("n_after"), "block",
    )


@register(
    "SELECT case_id, service, total_lines, novel_templates, snippets, infra_hits, silent_hits, tokens, text FROM evidence"
)
def log_evidence(spark, sf):
    inv = investigation(spark, sf)
    return inv.log_evidence.join(L.evidence_text(inv.snippets), L.SERIES)


@register("SELECT case_id, service, total_lines, novel_templates, snippets, budget_rank, truncated, tokens, text FROM kept")
def budget_services(spark, sf):
    return investigation(spark, sf).kept_logs.select(
        "case_id", "service", "total_lines", "novel_templates", "snippets", "budget_rank", "truncated", "tokens", "text"
    )
