"""One JSON document spread over tasks gives the rows of the document read as one."""

from __future__ import annotations

import json
import random

import pytest

from faultlens.sources import captures, metrics

T = 1680000000


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def metric_documents():
    rnd = random.Random(7)
    many = lambda n: [[T + i, rnd.choice([i, f"{i}.5", "NaN", "x]", None])] for i in range(n)]
    return {
        "nested": {"cart": {"cpu": many(90), "mem": []}, "pay": {"a]b[[1,2": many(3)}},
        "flat": {"one": many(120), "skip": 5, "two": [1, 2], "mixed": ["x", [T, 1], [T, 2]], "three": many(1), 'q"]\\': many(4), "run": ["\0ruin", 2]},
        "listed": [
            {"metric": "m1", "values": many(80)},
            {"values": many(2), "metric_name": "after"},
            {"metric": "empty", "values": []},
            {"metric": "deep", "data": [[]], "labels": {"a": ["]", "}"]}},
        ],
        "plain": {}, "none": [],
        "broken": None,
    }


@pytest.mark.parametrize("indent, end", [(None, ""), (1, "\n"), (None, "\n"), (2, "")])
def test_metric_documents(spark, tmp_path, small_splits, indent, end):
    for name, doc in metric_documents().items():
        (tmp_path / name).mkdir()
        text = "{not [[1, 2]] json" if doc is None else json.dumps(doc, indent=indent) + end
        (tmp_path / name / "metrics.json").write_text(text)
    whole = rows(metrics.read_metrics(spark, str(tmp_path), "json"))
    assert len(whole) > 150
    assert rows(metrics.read_metrics(spark, str(tmp_path), "json-split")) == whole


@pytest.mark.parametrize("indent", [None, 1])
def test_matrix(spark, tmp_path, small_splits, indent):
    series = lambda n, **labels: {"metric": labels, "values": [[T + i, str(i)] for i in range(n)]}
    (tmp_path / "run1").mkdir()
    doc = {"metric_name": "rss", "query": 'x{a="[["}', "data": [series(60, app="cart", path="/a]/[b"), series(0, app="none"), series(50, other="é]"), series(1)]}
    (tmp_path / "run1" / "m.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    (tmp_path / "run1" / "late.json").write_text(json.dumps({"data": [{"values": [[T, "1"], [T, "2"]], "metric": {"app": "x"}}], "query": "q", "metric_name": "n"}))
    whole = rows(captures.read_promql_matrix(spark, f"{tmp_path}/*/*.json"))
    assert len(whole) == 113
    split = captures.read_promql_matrix(spark, f"{tmp_path}/*/*.json", split=True)
    assert rows(split) == whole


@pytest.mark.parametrize("indent, end", [(None, ""), (1, "\n")])
def test_traces(spark, tmp_path, small_splits, indent, end):
    span = lambda t, n: {
        "traceID": t, "spanID": f"{t}-{n}", "operationName": 'o}{"\\', "startTime": n, "duration": 2, "processID": "p1",
        "references": [{"refType": "CHILD_OF", "traceID": t, "spanID": f"{t}-{n - 1}"}] if n else [],
        "tags": [{"key": "note", "value": "}]{"}],
    }
    trace = lambda t, n: {"traceID": t, "spans": [span(t, i) for i in range(n)], "processes": {"p1": {"serviceName": f"s{n}"}}}
    (tmp_path / "run1").mkdir()
    docs = {
        "a": {"data": [trace(f"t{i}", 1 + i % 5) for i in range(12)], "total": 0, "errors": [{"code": 1}]},
        "b": {"meta": {"n": 1}, "text": "x}y", "errors": [], "data": [trace("t0", 1), trace("u", 3), {"traceID": "v", "spans": []}]},
        "c": {"data": []},
        "d": {"data": None},
    }
    for name, doc in docs.items():
        (tmp_path / "run1" / f"{name}.json").write_text(json.dumps(doc, indent=indent) + end)
    whole = rows(captures.read_trace_json(spark, f"{tmp_path}/*/*.json"))
    assert len(whole) == 36
    assert rows(captures.read_trace_json(spark, f"{tmp_path}/*/*.json", split=True)) == whole


def test_a_document_is_read_by_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metrics.json").write_text(json.dumps({"m": [[T + i, i] for i in range(500)]}))
    raw = spark.read.option("lineSep", "]").text(f"{tmp_path}/c/metrics.json")
    assert raw.rdd.getNumPartitions() > 5
    got = metrics.read_metrics(spark, str(tmp_path), "json-split").orderBy("seq").collect()
    assert [(r.seq, r.ts - T, r.value) for r in got] == [(i, i, i) for i in range(500)]


def test_points_are_parsed_once(spark):
    """Filters on what a point holds stay above its parsing; pushed down they would parse every point once more."""
    from faultlens.sources import metrics

    docs = spark.createDataFrame([("c", '{"m": [["1705708800", "2.5"], ["1705708801", "bad"], ["never", "1"], [null, "1"]]}')], "case_id string, value string")
    got = metrics.json_points(docs)
    assert {(r.seq, r.ts, r.value) for r in got.collect()} == {(0, 1705708800.0, 2.5), (3, 0.0, 1.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Filter" in line and "$[1]" in line for line in plan)
