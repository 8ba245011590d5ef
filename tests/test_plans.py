from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from faultlens.plans import ordering, quantile


def test_running_values_cross_chunks(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else "cold", i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = ordering.running(
        df, ["k"], ["i"], F.floor(F.col("i") / 7), {"total": F.col("v")}, {"before": F.when(F.col("v") == 0, F.col("i"))},
        {"upto": F.when(F.col("v") == 1, F.col("i"))},
    )
    got = {(r.k, r.i): (r.total, r.before, r.upto) for r in out.collect()}
    for key in ("hot", "cold"):
        total, before, upto = 0, None, None
        for k, i, v in rows:
            if k != key:
                continue
            total += v
            upto = i if v == 1 else upto
            assert got[(k, i)] == (total, before, upto)
            before = i if v == 0 else before


def test_numbered_ties_and_chunks(spark):
    rows = [("a", float(i // 4), i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts double, seq long")
    out = ordering.numbered(df, ["k"], ["ts", "seq"], F.floor("ts"), "n")
    assert all(r.n == r.seq for r in out.collect())


def test_exact_ranks_of_large_and_small_groups(spark):
    rng = random.Random(3)
    groups = {
        "hot": [round(rng.lognormvariate(0, 2), 3) for _ in range(50_001)],
        **{f"few{n}": [float(rng.randrange(9)) for _ in range(n)] for n in range(1, 12)},
        "even": [float(rng.randrange(40)) for _ in range(3000)],
        "flat": [1.5] * 999,
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    medians = {r.k: (r.n, r.m) for r in quantile.exact_median(df, ["k"], "v", "m").collect()}
    p99 = {
        r.k: r.p
        for r in quantile.exact_ranks(df, ["k"], "v", 0.99, {"p": lambda n: F.greatest(F.lit(1), F.floor(n * 0.99))}).collect()
    }
    for k, vs in groups.items():
        assert medians[k] == (len(vs), statistics.median(vs))
        assert p99[k] == sorted(vs)[max(0, int(len(vs) * 0.99) - 1)]


def test_exact_ranks_count_no_nulls_and_hold_for_a_million_values(spark):
    few = spark.createDataFrame([("k", 1.0), ("k", None), ("k", 3.0), ("k", 2.0)], "k string, v double")
    assert quantile.exact_median(few, ["k"], "v", "m").first().m == 2.0
    n = 1_000_003
    many = spark.range(n).selectExpr("'k' AS k", f"CAST((id * 7919) % {n} AS DOUBLE) AS v")
    many = many.unionByName(spark.range(n).selectExpr("'k' AS k", "CAST(NULL AS DOUBLE) AS v"))
    assert quantile.exact_median(many, ["k"], "v", "m").first().m == (n - 1) / 2
    p99 = quantile.exact_ranks(many, ["k"], "v", 0.99, {"p": lambda c: F.floor(c * 0.99)}).first().p
    assert p99 == int(n * 0.99) - 1


def test_raw_rows_meet_cases_without_a_shuffle(spark):
    """Cases are written once, so Spark sees how small they are and broadcasts them by size, whatever made them."""
    from faultlens.operators import windows
    from faultlens.plans.materialize import materialize

    raw = spark.range(5000).selectExpr("concat('c', id % 8) AS case_id", "CAST(id AS DOUBLE) AS ts", "uuid() AS message")
    many = spark.range(200_000).selectExpr("concat('c', id % 8) AS case_id", "1000.0D AS inject_time")
    cases = materialize(many.distinct(), "cases")
    plan = windows.label_phase(raw, cases)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_evidence_is_slim_and_dealt_out_before_its_costly_steps(spark, monkeypatch):
    """Tags and logs of spans are not joined with phases; baseline lines get their signatures in tasks of their own."""
    from faultlens.operators import windows
    from queries import common

    taken, label = [], windows.label_trace_phase
    monkeypatch.setattr(windows, "label_trace_phase", lambda spans, *a: taken.append(spans.columns) or label(spans, *a))
    common.forget()
    inv = common.investigation(spark, "/root/testdata/sf0.001")
    assert "is_error" in inv.slim_spans.columns and not {"tags", "logs"} & {*taken[0], *inv.slim_spans.columns}
    assert "RepartitionByExpression [seq" in inv.annotated._jdf.queryExecution().analyzed().toString()


def test_signatures_of_the_baseline_are_not_computed_in_the_scan(spark):
    """A join on templates infers that they are not null, and that filter would run their signatures before the deal."""
    from queries import common

    common.forget()
    plan = common.investigation(spark, "/root/testdata/sf0.001").annotated._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    dealt = next(i for i, line in enumerate(lines) if "RepartitionByExpression [seq" in line)
    assert any("regexp_replace" in line for line in lines[:dealt])
    assert not any("regexp_replace" in line for line in lines[dealt:])


def test_lines_without_a_template_stay_as_they_were(spark):
    from faultlens.operators import logs

    schema = "case_id string, template string, line_no long"
    now = spark.createDataFrame([("a", "x", 0), ("a", "", 1), ("a", None, 2), ("a", "y", 3)], schema)
    calm = spark.createDataFrame([("a", "x", 0), ("a", None, 1)], schema)
    assert {r.line_no: r.is_novel for r in logs.flag_novel(now, calm).collect()} == {0: False, 1: False, 2: None, 3: True}


def test_the_number_of_tasks_grows_with_the_input(spark, tmp_path, monkeypatch):
    from faultlens import session

    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0").write_bytes(b"x" * 1000)
    (tmp_path / "b").write_bytes(b"x" * 500)
    monkeypatch.setattr(session, "INPUT_BYTES_A_PARTITION", 100)
    inputs = [str(tmp_path / "a"), str(tmp_path / "b")]
    session.bound_tasks(spark, *inputs)
    assert spark.conf.get(first) == "15" and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(16 << 20)
    monkeypatch.setattr(session, "INPUT_BYTES_A_PARTITION", 1000)
    session.bound_tasks(spark, *inputs)
    assert spark.conf.get(first, None) is None


def test_spans_are_read_with_bounded_tasks(spark, monkeypatch):
    from queries import common
    from queries.files import QUERIES

    asked = []
    monkeypatch.setattr(common, "bound_tasks", lambda session, *inputs: asked.append(inputs) or session)
    QUERIES["read_spans"](spark, "/root/testdata/sf0.001")
    assert len(asked[0]) == 3
