"""Log evidence: novelty, error candidates, windows, context, snippets and the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import text
from faultlens.plans.ordering import line_chunk, running

SERIES = ["case_id", "service"]
MARK_TARGET = "▶ [ERROR] "
MARK_CONTEXT = "  [ctx] "


def signature_templates(lines: DataFrame) -> DataFrame:
    """Signature → number of lines, per case and phase."""
    return (
        lines.withColumn("template", text.signature(F.col("line")))
        .filter(F.col("template") != "")
        .groupBy("case_id", "phase", "template")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def with_signatures(lines: DataFrame) -> DataFrame:
    return lines.withColumn("template", text.signature(F.col("line")))


def flag_novel(incident: DataFrame, baseline: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Mark lines whose template the baseline never had; a blank line is never novel.

    A case without any baseline of its own is held against the `saved` templates instead, if given.
    """
    # Without a null the join infers no filter on templates, which would compute each signature once more, in the scan.
    own = baseline.select("case_id", F.coalesce("template", F.lit("")).alias("template")).distinct().withColumn("__known", F.lit(True))
    judged = incident.join(own, ["case_id", "template"], "left")
    known = F.coalesce("__known", F.lit(False))
    if saved is not None:
        calm = own.select("case_id").distinct().withColumn("__calm", F.lit(True))
        shared = saved.select("template").distinct().withColumn("__saved", F.lit(True))
        judged = judged.join(calm, "case_id", "left").join(shared, "template", "left")
        known = F.when(F.col("__calm"), known).otherwise(F.coalesce("__saved", F.lit(False)))
    return judged.withColumn("is_novel", ~known & (F.col("template") != "")).select(*incident.columns, "is_novel")


def choose_baseline(runs: DataFrame, newest: int = K.BASELINE_RUNS) -> DataFrame:
    """Lines of the newest successful runs; `runs` has one row per line with run_id and status."""
    names = runs.filter(F.col("status") == "SUCCESS").select("run_id").distinct()
    chosen = names.orderBy(F.col("run_id").desc()).limit(newest)
    return runs.join(chosen, "run_id", "left_semi")


def annotate(lines: DataFrame) -> DataFrame:
    """Keyword and probe facts of incident lines that already carry template and novelty."""
    return lines.withColumns(
        {"keyword": text.match_keyword(F.col("line")), "probe": text.is_probe(F.col("line"))}
    )


def error_candidates(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("keyword").isNotNull() | F.col("is_novel"))


def novel_counts(annotated: DataFrame) -> DataFrame:
    """Lines and distinct novel templates per service."""
    novel = annotated.filter(F.col("is_novel")).select(*SERIES, "template").distinct()
    counts = novel.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("novel_templates"))
    totals = annotated.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("total_lines"))
    return totals.join(counts, SERIES, "left").withColumn(
        "novel_templates", F.coalesce("novel_templates", F.lit(0).cast("bigint"))
    )


def with_positions(annotated: DataFrame) -> DataFrame:
    """Add what windows and contexts need: the previous candidate and a count of non-probe lines.

    Windows, contexts and counts all read the result, so it is written to the shared folder. It needs no texts:
    leave `line` out and give what reads texts the numbered lines instead.
    """
    is_candidate = F.col("keyword").isNotNull() | F.col("is_novel")
    return running(
        annotated,
        SERIES,
        ["line_no"],
        line_chunk(),
        sums={"solid_upto": F.when(F.col("probe"), 0).otherwise(1).cast("bigint")},
        prior_max={"previous_candidate": F.when(is_candidate, F.col("line_no"))},
        store="positioned",
    )


def merge_windows(positioned: DataFrame, before: int = K.CONTEXT_BEFORE, after: int = K.CONTEXT_AFTER) -> DataFrame:
    """Candidates with the id (first line) of the merged window they fall into."""
    starts = F.col("previous_candidate").isNull() | (
        F.col("line_no") - F.col("previous_candidate") > before + after + 1
    )
    return running(
        error_candidates(positioned),
        SERIES,
        ["line_no"],
        line_chunk(),
        upto_max={"window_id": F.when(starts, F.col("line_no"))},
    )


def primary_target(windows: DataFrame) -> DataFrame:
    """One candidate per window: its first keyword hit, else its first line."""
    rank = F.struct(F.col("keyword").isNull(), F.col("line_no"))
    texts = [c for c in ("line",) if c in windows.columns]
    facts = F.struct("line_no", "keyword", "template", "is_novel", *texts, "probe", "solid_upto")
    return (
        windows.groupBy(*SERIES, "window_id")
        .agg(F.min_by(facts, rank).alias("t"), F.count(F.lit(1)).alias("targets"))
        .select(*SERIES, "window_id", "targets", "t.*")
    )


def with_texts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add `line` to rows that name a (case, service, line_no): texts are read for wanted lines only."""
    return rows.join(lines.select(*SERIES, "line_no", "line"), [*SERIES, "line_no"])


def _neighbours(targets: DataFrame, positioned: DataFrame, offsets: list[int], lines: DataFrame | None = None) -> DataFrame:
    """Non-probe lines at wanted distances from each target, found by equality on their running number.

    Their texts come from `lines` (case_id, service, line_no, line), else from `positioned` itself.
    """
    # Number of the last solid line before the target; the target itself counts when it is no probe.
    base = F.col("solid_upto") - F.when(F.col("probe"), 0).otherwise(1)
    step = F.col("__k")
    wanted = targets.withColumn("__k", F.explode(F.array(*[F.lit(o) for o in offsets]))).select(
        *SERIES,
        F.col("line_no").alias("target_no"),
        step.alias("k"),
        F.when(step < 0, base + 1 + step).otherwise(F.col("solid_upto") + step).alias("solid_upto"),
    )
    texts = ["line"] if lines is None else []
    solid = positioned.filter(~F.col("probe")).select(*SERIES, "solid_upto", "line_no", *texts)
    found = wanted.join(solid, [*SERIES, "solid_upto"]).drop("solid_upto")
    return found if lines is None else with_texts(found, lines).select(*found.columns, "line")


def context_before(
    targets: DataFrame, positioned: DataFrame, before: int = K.CONTEXT_BEFORE, lines: DataFrame | None = None
) -> DataFrame:
    """Nearest non-probe lines before each target: rows (target_no, k, line_no, line), k = −1, −2, …"""
    return _neighbours(targets, positioned, [-k for k in range(1, before + 1)], lines)


def context_after(
    targets: DataFrame,
    positioned: DataFrame,
    after: int = K.CONTEXT_AFTER,
    extra: int = K.CONTINUATION_EXTRA,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Non-probe lines after each target; beyond `after` only while they carry on a stack trace."""
    rows = _neighbours(targets, positioned, list(range(1, after + extra + 1)), lines)
    stop = rows.filter((F.col("k") > after) & ~text.is_continuation(F.col("line")))
    first_stop = stop.groupBy(*SERIES, "target_no").agg(F.min("k").alias("__stop"))
    return (
        rows.join(first_stop, [*SERIES, "target_no"], "left")
        .filter(F.col("__stop").isNull() | (F.col("k") < F.col("__stop")))
        .drop("__stop")
    )


def context_plain(
    targets: DataFrame, lines: DataFrame, before: int = K.CONTEXT_BEFORE, after: int = K.CONTEXT_AFTER
) -> DataFrame:
    """Lines at −before … +after around each target, probes and all."""
    offsets = [k for k in range(-before, after + 1) if k]
    wanted = targets.select(
        *SERIES, F.col("line_no").alias("target_no"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("k")
    ).withColumn("line_no", F.col("target_no") + F.col("k"))
    return with_texts(wanted, lines)


def snippets(
    targets: DataFrame,
    positioned: DataFrame,
    before: int = K.CONTEXT_BEFORE,
    after: int = K.CONTEXT_AFTER,
    extra: int = K.CONTINUATION_EXTRA,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Snippet rows with both contexts and the text block; one lookup serves both contexts."""
    offsets = [-k for k in range(1, before + 1)] + list(range(1, after + extra + 1))
    rows = _neighbours(targets, positioned, offsets, lines)
    breaks = (F.col("k") > after) & ~text.is_continuation(F.col("line"))
    # At most before + after + extra lines per target, so the arrays are bounded.
    around = rows.groupBy(*SERIES, F.col("target_no").alias("line_no")).agg(
        F.sort_array(F.collect_list(F.struct("k", "line"))).alias("near"),
        F.min(F.when(breaks, F.col("k"))).alias("stop"),
    )
    none = F.array().cast("array<struct<k:int,line:string>>")
    near = F.coalesce(F.col("near"), none)
    line_of = lambda x: x["line"]
    out = targets.join(around, [*SERIES, "line_no"], "left").select(
        *SERIES,
        (F.col("line_no") + 1).alias("line_number"),
        "keyword",
        "template",
        "is_novel",
        F.transform(F.filter(near, lambda x: x["k"] < 0), line_of).alias("context_before"),
        F.col("line").alias("target_line"),
        F.transform(
            F.filter(near, lambda x: (x["k"] > 0) & (F.col("stop").isNull() | (x["k"] < F.col("stop")))), line_of
        ).alias("context_after"),
    )
    mark = lambda x: F.concat(F.lit(MARK_CONTEXT), x)
    return out.withColumn(
        "block",
        F.array_join(
            F.concat(
                F.transform("context_before", mark),
                F.array(F.concat(F.lit(MARK_TARGET), F.col("target_line"))),
                F.transform("context_after", mark),
            ),
            "\n",
        ),
    )


def _header() -> Column:
    return F.concat(F.lit("--- Service: "), F.col("service"), F.lit(" ---\n"))


def log_evidence(snips: DataFrame, counts: DataFrame) -> DataFrame:
    """Evidence per service that has snippets: counts, phrase hits and the token estimate of its whole text."""
    low = F.lower("target_line")
    totals = snips.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("snippets"),
        (F.sum(F.length("block") + 2) - 2).alias("__chars"),
        F.count_if(text.contains_any(low, K.INFRA_PHRASES)).alias("infra_hits"),
        F.count_if(text.contains_any(low, K.SILENT_PHRASES)).alias("silent_hits"),
    )
    return totals.join(counts, SERIES).select(
        *SERIES,
        "total_lines",
        "novel_templates",
        "snippets",
        "infra_hits",
        "silent_hits",
        text.tokens_for_length(F.length(_header()) + F.col("__chars")).alias("tokens"),
    )


def evidence_text(snips: DataFrame) -> DataFrame:
    """(case, service, text): all snippets of each service in one text, for those who ask for it whole."""
    blocks = F.sort_array(F.collect_list(F.struct("line_number", "block")))
    return (
        snips.groupBy(*SERIES)
        .agg(blocks.alias("__b"))
        .select(*SERIES, F.concat(_header(), F.array_join(F.transform("__b", lambda x: x["block"]), "\n\n")).alias("text"))
    )


def budget_services(evidence: DataFrame, snips: DataFrame, budget: int = K.LOG_TOKEN_BUDGET) -> DataFrame:
    """Services kept under the case's token budget, in priority order, with their texts.

    The first service that overflows is cut to what remains when that is worth it; nothing follows it. A text is put
    together once its service is kept. It has at most `budget` tokens, and a block takes at least 12 characters with
    its separator, so the first `most` snippets hold every text.
    """
    most = (budget * 4 + 4) // 12 + 1
    order = Window.partitionBy("case_id").orderBy(
        F.col("snippets").desc(), F.col("novel_templates").desc(), F.col("service")
    )
    used = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = evidence.withColumns({"budget_rank": F.row_number().over(order), "__used": used})
    over = F.col("__used") > budget
    first_over = F.min(F.when(over, F.col("budget_rank"))).over(Window.partitionBy("case_id"))
    left = F.greatest(F.lit(0), F.lit(budget) - (F.col("__used") - F.col("tokens")))
    kept = (
        ranked.withColumns({"__first": first_over, "__left": left})
        .filter(
            F.col("__first").isNull()
            | (F.col("budget_rank") < F.col("__first"))
            | ((F.col("budget_rank") == F.col("__first")) & (F.col("__left") > K.MIN_TRUNCATED_TOKENS))
        )
        .withColumn("truncated", over)
    )
    first = Window.partitionBy(*SERIES).orderBy("line_number")
    read = snips.join(kept.select(*SERIES), SERIES, "left_semi").select(*SERIES, "line_number", "block")
    read = read.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= most)
    kept = kept.join(evidence_text(read), SERIES)
    cut = F.concat(F.substring("text", F.lit(1), (F.col("__left") * 4).cast("int")), F.lit(K.TRUNCATED_SUFFIX))
    return kept.withColumns(
        {
            "text": F.when(F.col("truncated"), cut).otherwise(F.col("text")),
            "tokens": F.when(F.col("truncated"), F.col("__left")).otherwise(F.col("tokens")),
        }
    ).drop("__used", "__first", "__left")
