from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.operators import evaluation, windows
from faultlens.sources import aliases, captures, cases, logs, metrics, results, snapshots, spans

T = 1680000000.0


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    for n, case in enumerate(["re2ob_cart_cpu_1", "re2ob_pay_mem_2"]):
        d = root / case
        d.mkdir()
        (d / "inject_time.txt").write_text(f" {int(T * 1000)}\n")
        pd.DataFrame(
            {
                "timestamp": [T - 20, T - 10, T - 700, T, T + 5],
                "container_name": ["cart", None, "cart", "cart", " "],
                "message": [" calm ", "x", "too old", "error: boom", None],
            }
        ).to_parquet(d / "logs.parquet")
        pd.DataFrame({"time": [T - 5, T + 5], f"svc{n}_cpu": [1.0, None], "shared_mem": [2.0, 3.0]}).to_parquet(d / "metrics.parquet")
        pd.DataFrame(
            {
                "startTime": [int((T - 9) * 1e6), int((T + 1) * 1e6), int((T + 2) * 1e6)],
                "traceID": ["a", "b", None], "spanID": ["a1", None, "b2"], "parentSpanID": ["None", "0", "b1"],
                "serviceName": ["cart", None, "pay"], "operationName": ["get", "put", None],
                "duration": [1500.0, None, 99.9], "statusCode": ["200", "504", "failed"],
            }
        ).to_parquet(d / "traces.parquet")
    pd.DataFrame(
        {
            "case": ["re2ob_cart_cpu_1", "re2ob_pay_mem_2", "re2ob_no_files_3"], "dataset": ["RE2-OB"] * 3,
            "root_cause_service": ["cart", "pay", "x"], "fault": ["cpu", "mem", "cpu"], "has_logs": [True, True, False], "has_traces": [True] * 3,
        }
    ).to_parquet(root / "cases.parquet")
    return str(root)


def test_logs_phases_and_defaults(spark, root):
    times = cases.read_inject_times(spark, root)
    assert {r.inject_time for r in times.collect()} == {T}
    rows = windows.label_phase(logs.read_logs(spark, root), times).filter("case_id = 're2ob_cart_cpu_1'")
    lines = windows.number_lines(rows).orderBy("ts").collect()
    assert [(r.phase, r.service, r.line_no, r.message) for r in lines] == [
        ("baseline", "cart", 0, "calm"), ("baseline", "unknown_service", 0, "x"),
        ("incident", "cart", 0, "error: boom"), ("incident", "unknown_service", 0, ""),
    ]
    assert lines[2].line == "[2023-03-28T10:40:00+00:00] error: boom"


def test_wide_metrics_of_differing_cases(spark, root):
    got = {(r.case_id[6:10], r.metric_name, r.ts - T, r.value) for r in metrics.read_metrics(spark, root).collect()}
    assert got == {
        ("cart", "svc0_cpu", -5.0, 1.0), ("cart", "shared_mem", -5.0, 2.0), ("cart", "shared_mem", 5.0, 3.0),
        ("pay_", "svc1_cpu", -5.0, 1.0), ("pay_", "shared_mem", -5.0, 2.0), ("pay_", "shared_mem", 5.0, 3.0),
    }


def test_spans_defaults_and_trace_phase(spark, root):
    df = spans.read_spans(spark, root).filter("case_id = 're2ob_cart_cpu_1'")
    rows = {r.start_us: r for r in df.collect()}
    first, second, third = (rows[int((T + d) * 1e6)] for d in (-9, 1, 2))
    assert (first.parent_id, first.duration_us, first.service) == (None, 1500, "cart")
    assert second.span_id.startswith("b_") and second.service == "unknown_service" and second.duration_us == 0
    assert {t.key: t.value for t in second.tags} == {
        "service.name": "unknown_service", "operation.name": "put", "error": "true", "http.status_code": "504",
    }
    assert (third.trace_id, third.operation, third.parent_id, third.duration_us) == ("tr_unknown", "unknown_op", "b1", 99)
    assert not any(t.key == "error" for t in third.tags)
    phases = windows.label_trace_phase(df, cases.read_inject_times(spark, root))
    assert {(r.trace_id, r.phase) for r in phases.collect()} == {("a", "baseline"), ("b", "incident"), ("tr_unknown", "incident")}


def test_discovery_needs_all_files(spark, root):
    registry = cases.read_registry(spark, f"{root}/cases.parquet")
    files = cases.list_files(spark, root)
    found = windows.discover_cases(registry, files, faults=["CPU", "MEM"], limit=5)
    assert sorted(r.case_id for r in found.collect()) == ["re2ob_cart_cpu_1", "re2ob_pay_mem_2"]
    assert windows.discover_cases(registry, files, suites=["re2-ob"], faults=["mem"]).count() == 1
    inventory = evaluation.file_inventory(registry, files, spark.createDataFrame([("re2ob_cart_cpu_1", "fusion")], "case_id string, mode string"))
    rows = {r.case_id: r for r in inventory.collect()}
    assert rows["re2ob_cart_cpu_1"].has_logs_file and rows["re2ob_cart_cpu_1"].modes == ["fusion"]
    assert not rows["re2ob_no_files_3"].has_logs_file and rows["re2ob_no_files_3"].logs_bytes == 0


def test_csv_logs_and_spans(spark, tmp_path):
    d = tmp_path / "c1"
    d.mkdir()
    (d / "logs.csv").write_text('time,service,message\n1680000000,cart,"a, b"\nnever,cart,lost\n2023-03-28T10:40:01Z,,x\n')
    (d / "traces.csv").write_text(
        "time,trace_id,span_id,parent_id,service,operation,duration_ms,status\n"
        "1680000000,t1,s1,,cart,get,12.5,200\n1680000000,t1,,s1,,,200000,failed\nbad,t1,s3,s1,a,b,1,200\n"
    )
    got = [(r.ts, r.service, r.message) for r in logs.read_logs(spark, str(tmp_path), "csv").orderBy("ts").collect()]
    assert got == [(T, "cart", "a, b"), (T + 1, "unknown_service", "x")]
    rows = spans.read_spans(spark, str(tmp_path), "csv").orderBy("seq").collect()
    assert [(r.duration_us, r.service, r.operation, r.parent_id) for r in rows] == [
        (12500, "cart", "get", None), (200000, "unknown_service", "unknown_op", "s1"),
    ]
    assert any(t.key == "error" for t in rows[1].tags)


def test_metrics_json_layouts(spark, tmp_path):
    docs = {
        "nested": {"cart": {"cpu": [[T, 1], [T + 1, "2.5"], ["bad"], [T, "x"]]}},
        "flat": {"cart/cpu": [[T * 1000, 3]], "skip": 5},
        "listed": [{"metric": "m1", "values": [[T, 4]]}, {"metric_name": "m2", "data": [["2023-03-28T10:40:00Z", 5]]}, {"values": [[T, 6]]}],
        "broken": None,
    }
    for name, doc in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps(doc) if doc else "{not json")
    got = sorted((r.case_id, r.metric_name, r.ts - T, r.value) for r in metrics.read_metrics(spark, str(tmp_path), "json").collect())
    assert got == [
        ("flat", "cart/cpu", 0.0, 3.0), ("listed", "m1", 0.0, 4.0), ("listed", "m2", 0.0, 5.0), ("listed", "unknown", 0.0, 6.0),
        ("nested", "cart/cpu", 0.0, 1.0), ("nested", "cart/cpu", 1.0, 2.5),
    ]


def test_snapshots_nested_and_flat(spark, tmp_path):
    span = {
        "traceID": "t", "spanID": "s2", "operationName": "op", "references": [{"refType": "CHILD_OF", "traceID": "t", "spanID": "s1"}],
        "startTime": 5, "duration": 7, "tags": [{"key": "service.name", "value": "pay"}, {"key": "error", "value": True}, {"key": "http.status_code", "value": 503}],
    }
    telemetry = {
        "logs": {"pay": ["[2023-03-28T10:40:00+00:00] one", "two"]},
        "metrics": [{"metric_name": "pay/cpu", "query": "q", "data": [{"timestamp": T, "value": 1.5}]}],
        "traces": [{"traceID": "t", "spans": [span]}],
    }
    (tmp_path / "a_telemetry.json").write_text(json.dumps({"run_id": "flat", **telemetry}, indent=1))
    (tmp_path / "b_telemetry.json").write_text(json.dumps({"run_id": "nested", "inject_time": T, "telemetry": telemetry, "baseline": telemetry}, indent=1))
    got = snapshots.read_snapshots(spark, f"{tmp_path}/*_telemetry.json")
    lines = {(r.case_id, r.phase, r.line_no, r.ts) for r in got["logs"].collect()}
    assert lines == {(c, p, n, t) for c, p in (("flat", "incident"), ("nested", "incident"), ("nested", "baseline")) for n, t in ((0, T), (1, None))}
    assert got["points"].count() == 3
    s = got["spans"].filter("case_id = 'flat'").first()
    assert (s.parent_id, s.service) == ("s1", "pay") and {t.key: t.value for t in s.tags}["error"] == "true"


def test_captures(spark, tmp_path):
    d = tmp_path / "run1"
    d.mkdir()
    (d / "m.json").write_text(json.dumps({"metric_name": "memory_rss", "query": "q", "data": [
        {"metric": {"container_label_com_docker_compose_service": "cart"}, "values": [[T, "10"], [T + 5, "12"]]}, {"metric": {}, "values": [[T, "1"]]}]}))
    points = {(r.case_id, r.metric_name, r.value) for r in captures.read_promql_matrix(spark, f"{tmp_path}/*/m.json").collect()}
    assert points == {("run1", "cart/memory_rss", 10.0), ("run1", "cart/memory_rss", 12.0), ("run1", "memory_rss", 1.0)}
    doc = {"data": [{"traceID": "t", "spans": [{"traceID": "t", "spanID": "s", "operationName": "o", "startTime": 1, "duration": 2, "processID": "p1"}],
                     "processes": {"p1": {"serviceName": "front"}}}]}
    for n in ("t1.json", "t2.json"):
        (d / n).write_text(json.dumps(doc))
    got = captures.read_trace_json(spark, f"{tmp_path}/*/t*.json").collect()
    assert [(r.case_id, r.span_id, r.service) for r in got] == [("run1", "s", "front")]
    (d / "cart.log").write_text("2023-03-28T10:40:00.5Z hello\n\n  \n2023-03-28T10:41:44Z slack\n2023-03-28T10:41:46Z late\nno time\n")
    window = spark.createDataFrame([("run1", T, T + 100)], "case_id string, start_ts double, end_ts double")
    lines = sorted(r.line.split()[-1] for r in captures.read_container_logs(spark, f"{tmp_path}/*/*.log", window).collect())
    assert lines == ["hello", "slack", "time"]


def test_score_csv_and_merges(spark, tmp_path):
    path = tmp_path / "scores" / "mode=fusion"
    path.mkdir(parents=True)
    head = "case_id,ground_truth_service,predicted_service,ranked_candidates,ground_truth_fault,predicted_category,top1_hit,top3_hit,mrr,fault_match,confidence,prompt_tokens,duration_ms,engine_type"
    (path / "a.csv").write_text(f"{head}\nc1,cart,cart,cart;pay;,cpu,EC,True,True,1.0,False,0.9,100,5.5,X\nc2,cart,pay,,cpu,EC,False,true,,True,bad,,,X\n,,,,,,,,,,,,,\n")
    rows = {r.case_id: r for r in results.read_scores(spark, str(tmp_path / "scores")).collect()}
    assert set(rows) == {"c1", "c2"}
    assert rows["c1"].ranked_candidates == ["cart", "pay"] and rows["c1"].error_bucket == "category_miss"
    assert (rows["c2"].mrr, rows["c2"].confidence, rows["c2"].prompt_tokens, rows["c2"].error_bucket) == (0.0, 0.0, 0, "ranking_miss")
    old = spark.createDataFrame([("c1", "fusion", "old", 1), ("c2", "fusion", "old", 1)], "case_id string, mode string, v string, created_at int")
    new = spark.createDataFrame([("c2", "fusion", "new", 2), ("c3", "fusion", "new", 2)], "case_id string, mode string, v string, created_at int")
    assert {(r.case_id, r.v) for r in results.upsert_results(old, new).collect()} == {("c1", "old"), ("c2", "new"), ("c3", "new")}
    assert {(r.case_id, r.v) for r in results.insert_missing(old, new).collect()} == {("c1", "old"), ("c2", "old"), ("c3", "new")}


def test_artifact_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    df = spark.createDataFrame([("c1", "fusion", 1), ("c2", "fusion", 1), ("c1", "logs-only", 1)], "case_id string, mode string, v int")
    results.write_artifacts(df, path)
    results.write_artifacts(df.filter("case_id = 'c2'").withColumn("v", F.lit(2)), path)
    got = {(r.case_id, r.mode, r.v, r.source) for r in results.read_artifacts(spark, path).collect()}
    assert got == {("c1", "fusion", 1, "cache"), ("c2", "fusion", 2, "cache"), ("c1", "logs-only", 1, "cache")}


def test_cases_with_differing_files(spark, tmp_path):
    """Other column names, other formats, quotes and line breaks: every row of every case comes back."""
    for case, names in (("a", ("timestamp", "message")), ("b", ("time", "log"))):
        spark.createDataFrame([(1_700_000_000.5, f"from {case}")], f"{names[0]} double, {names[1]} string").write.parquet(f"{tmp_path}/{case}/logs.parquet")
    csv = tmp_path / "c"
    csv.mkdir()
    (csv / "logs.csv").write_text('\ufeffhost,datetime,content,app\n"x,y",1700000001,"said ""hello, world"" twice\n  at line 2",svc\n,never,dropped,svc\n')
    (tmp_path / "a" / "logs.csv").write_text("time,message\n1,not read: there is a better file\n")
    got = {(r.case_id, r.ts, r.service, r.message) for r in logs.read_logs(spark, str(tmp_path), "auto").collect()}
    assert got == {
        ("a", 1_700_000_000.5, "unknown_service", "from a"),
        ("b", 1_700_000_000.5, "unknown_service", "from b"),
        ("c", 1_700_000_001.0, "svc", 'said "hello, world" twice\n  at line 2'),
    }
    kept = logs.read_logs(spark, str(tmp_path), "csv", keep_untimed=True)
    assert kept.filter("ts IS NULL").count() == 1


def test_spans_of_differing_files(spark, tmp_path):
    for case, head in (("a", "time,trace_id,span_id,parent_id,service,duration_ms"), ("b", "latency,spanId,traceId,app,start_time")):
        (tmp_path / case).mkdir()
        line = "1700000000,t,s,none,svc,5" if case == "a" else "7000,s,t,svc,1700000000"
        (tmp_path / case / "traces.csv").write_text(f"{head}\n{line}\n")
    got = {(r.case_id, r.trace_id, r.span_id, r.service, r.start_us, r.duration_us) for r in spans.read_spans(spark, str(tmp_path), "auto").collect()}
    assert got == {(c, "t", "s", "svc", 1_700_000_000_000_000, d) for c, d in (("a", 5000), ("b", 7000))}


def test_saved_templates(spark, tmp_path):
    results.write_templates(spark.createDataFrame([("x",), ("x",), ("y",)], "template string"), f"{tmp_path}/t")
    assert {r.template for r in results.read_templates(spark, f"{tmp_path}/t").collect()} == {"x", "y"}


def test_csv_rows_are_short_for_no_more_columns_than_are_read(spark, tmp_path):
    """The parser picks the columns that are read out of one more, so a row that lacks some costs no exception each."""
    path = tmp_path / "c" / "traces.csv"
    path.parent.mkdir()
    path.write_text("time,traceId,spanId,service,duration_ms\n1705708800,t,s1,a,2\n1705708801,t,s2\n")
    df, _ = aliases.scan_columns(spark, str(tmp_path), "traces.csv", "csv", "folders", K.SPAN_COLUMNS_CSV, ("time", "trace"))
    assert "__spare" not in df.columns
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = df._jdf.queryExecution()
    shown = plan.analyzed().toString(), plan.executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "__spare" in shown[0] and "__spare" not in shown[1]
    rows = spans.read_spans(spark, str(tmp_path), "csv").select("span_id", "service", "duration_us").collect()
    assert sorted(map(tuple, rows)) == [("s1", "a", 2000), ("s2", "unknown_service", 0)]


def test_trace_captures_are_stored_packed(spark, monkeypatch):
    from queries import files

    paths, path = [], files.scratch_path
    monkeypatch.setattr(files, "scratch_path", lambda *a: paths.append(path(*a)) or paths[-1])
    got = files.QUERIES["read_trace_json"](spark, "/root/testdata/sf0.001")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(paths[0])
    names = [r.path for r in stored.select("path").collect()]
    assert names and all(n.endswith(".json.gz") for n in names)
    spans = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert got.count() == spans.count()
