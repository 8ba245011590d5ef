from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import logs as L
from faultlens.plans import ordering

PROBE = "GET /healthz 200"


def annotated(spark, lines_by_service, novel=()):
    rows = [
        ("c", s, i, line, f"t {line}", (s, i) in novel)
        for s, lines in lines_by_service.items()
        for i, line in enumerate(lines)
    ]
    df = spark.createDataFrame(rows, "case_id string, service string, line_no long, line string, template string, is_novel boolean")
    return L.annotate(df)


def expected_snippets(lines, novel, keyword, m=3, n=7, extra=15):
    """Straight loop over one service, as a check."""
    probe = lambda x: "/healthz" in x
    cont = lambda x: x.startswith("  ") or x.startswith("at ")
    hits = [i for i, x in enumerate(lines) if keyword in x or i in novel]
    windows = []
    for i in hits:
        if windows and i - windows[-1][-1] <= m + n + 1:
            windows[-1].append(i)
        else:
            windows.append([i])
    out = []
    for w in windows:
        t = next((i for i in w if keyword in lines[i]), w[0])
        before = [x for x in lines[:t] if not probe(x)][-m:]
        after = []
        for x in lines[t + 1 :]:
            if probe(x):
                continue
            if len(after) < n or (len(after) < n + extra and cont(x)):
                after.append(x)
            else:
                break
        out.append((t + 1, before, after))
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 100_000), (2, 5), (3, 3), (4, 11)])
def test_windows_and_contexts_against_loop(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ordering, "CHUNK_LINES", chunk)
    rng = random.Random(seed)
    words = ["ok work", PROBE, "error boom", "  at frame", "plain", "plain", "plain two", "steady", "steady on", "tick"]
    data = {s: [f"{rng.choice(words)} {i}" for i in range(rng.randrange(20, 120))] for s in ("a", "b")}
    data["b"] = [x.replace("error boom", "plain") for x in data["b"]]
    novel = {("b", i) for i in range(0, len(data["b"]), 17)}
    positioned = L.with_positions(annotated(spark, data, novel))
    targets = L.primary_target(L.merge_windows(positioned))
    got = {}
    for r in L.snippets(targets, positioned).collect():
        got.setdefault(r.service, []).append((r.line_number, r.context_before, r.context_after))
    for s, lines in data.items():
        want = expected_snippets(lines, {i for t, i in novel if t == s}, "error")
        assert sorted(got.get(s, [])) == want
    # The single context operators agree with the snippet arrays.
    after = {}
    for r in L.context_after(targets, positioned).collect():
        after.setdefault((r.service, r.target_no), []).append((r.k, r.line))
    for s, rows in got.items():
        for number, _, lines in rows:
            assert [x for _, x in sorted(after.get((s, number - 1), []))] == lines


def test_probes_are_skipped_and_stack_kept(spark):
    stack = ["error start"] + [f"    at frame{i}" for i in range(6)] + ["normal again"]
    positioned = L.with_positions(annotated(spark, {"s": [PROBE, "before", PROBE] + stack}))
    targets = L.primary_target(L.merge_windows(positioned))
    row = L.snippets(targets, positioned, before=2, after=2).first()
    assert row.context_before == ["before"]
    assert row.context_after == stack[1:7]


def test_plain_context(spark):
    lines = [f"line {i}" if i != 10 else "error here" for i in range(20)]
    positioned = L.with_positions(annotated(spark, {"s": lines}))
    targets = L.primary_target(L.merge_windows(positioned))
    rows = sorted((r.k, r.line_no) for r in L.context_plain(targets, positioned).collect())
    assert [n for _, n in rows] == [7, 8, 9, 11, 12, 13, 14, 15, 16, 17]


def test_budget_cuts_first_overflow_and_stops(spark):
    sizes = [600, 700, 900, 10]
    rows = [("c", f"s{i}", 10, 0, 9 - i, 0, 0, t) for i, t in enumerate(sizes)]
    ev = spark.createDataFrame(
        rows,
        "case_id string, service string, total_lines long, novel_templates long, snippets long, infra_hits long, silent_hits long, tokens long",
    )
    snips = spark.createDataFrame(
        [("c", f"s{i}", n, "x" * (t * 2 - 10)) for i, t in enumerate(sizes) for n in (1, 2)],
        "case_id string, service string, line_number long, block string",
    )
    kept = {r.service: r for r in L.budget_services(ev, snips).collect()}
    assert set(kept) == {"s0", "s1", "s2"}
    assert kept["s2"].tokens == 200 and kept["s2"].truncated
    whole = "--- Service: s2 ---\n" + "x" * 1790 + "\n\n" + "x" * 1790
    assert kept["s2"].text == whole[:800] + "\n...[truncated for token budget]"
    assert kept["s0"].text == "--- Service: s0 ---\n" + "x" * 1190 + "\n\n" + "x" * 1190
    # A remainder of 100 tokens or less is not worth a cut.
    tight = ev.withColumn("tokens", F.when(F.col("service") == "s1", 850).otherwise(F.col("tokens")))
    assert {r.service for r in L.budget_services(tight, snips).collect()} == {"s0", "s1"}


def test_texts_looked_up_equal_texts_carried(spark):
    lines = {"s": [f"{'error' if i % 9 == 4 else PROBE if i % 5 == 0 else '  at'} {i}" for i in range(90)]}
    carried = L.with_positions(annotated(spark, lines))
    slim = L.with_positions(annotated(spark, lines).drop("line"))
    texts = annotated(spark, lines).select("case_id", "service", "line_no", "line")
    assert "line" not in slim.columns
    find = lambda p: L.primary_target(L.merge_windows(p, 1, 1))
    a, b = find(carried), L.with_texts(find(slim), texts)
    want, got = L.snippets(a, carried), L.snippets(b, slim, lines=texts)
    assert want.columns == got.columns and sorted(want.collect()) == sorted(got.collect()) and got.count() > 5
    for f in (L.context_before, L.context_after):
        want, got = f(a, carried), f(b, slim, lines=texts)
        assert want.columns == got.columns and sorted(want.collect()) == sorted(got.collect())


def test_long_service_text_is_whole(spark):
    lines = [x for i in range(900) for x in (["error " + str(i)] + ["fill"] * 12)]
    positioned = L.with_positions(annotated(spark, {"s": lines}))
    snips = L.snippets(L.primary_target(L.merge_windows(positioned)), positioned)
    ev = L.log_evidence(snips, L.novel_counts(positioned)).first()
    blocks = [r.block for r in snips.orderBy("line_number").collect()]
    whole = "--- Service: s ---\n" + "\n\n".join(blocks)
    assert ev.snippets == len(blocks)
    assert ev.tokens == len(whole) // 4
    assert L.evidence_text(snips).first().text == whole


def test_saved_baseline_is_used_only_without_own(spark):
    lines = spark.createDataFrame([(c, t) for c in ("a", "b") for t in ("own", "saved", "new")], "case_id string, template string")
    own = spark.createDataFrame([("a", "own")], "case_id string, template string")
    saved = spark.createDataFrame([("saved",)], "template string")
    got = {(r.case_id, r.template) for r in L.flag_novel(lines, own, saved).filter("is_novel").collect()}
    assert got == {("a", "saved"), ("a", "new"), ("b", "own"), ("b", "new")}
    bare = {(r.case_id, r.template) for r in L.flag_novel(lines, own).filter("is_novel").collect()}
    assert bare == {("a", "saved"), ("a", "new"), ("b", "own"), ("b", "saved"), ("b", "new")}


def test_newest_successful_runs(spark):
    runs = spark.createDataFrame([(f"r{i}", "FAILED" if i == 8 else "SUCCESS", f"l{i}") for i in range(9)], "run_id string, status string, line string")
    assert sorted(r.run_id for r in L.choose_baseline(runs).collect()) == ["r5", "r6", "r7"]
