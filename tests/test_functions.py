from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import clock, naming, spans, text
from faultlens.sources.aliases import aliases_in


def column(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


def test_epoch_units(spark):
    values = [1680000000.0, 1680000000000.0, 1680000000000000.0, 1680000000000000000.0, None]
    assert column(spark, values, clock.epoch_seconds, "double") == [1680000000.0] * 4 + [0.0]


def test_parse_ts(spark):
    got = column(
        spark,
        ["1680000000", "1680000000000", "2023-03-28T10:40:00Z", "2023-03-28 10:40:00.500", "2023-03-28T12:40:00+02:00", "12d", "soon", ""],
        clock.parse_ts,
    )
    assert got == [1680000000.0, 1680000000.0, 1680000000.0, 1680000000.5, 1680000000.0, None, None, None]


def test_line_format_round_trip(spark):
    df = spark.createDataFrame([(1680000000.0,), (1680000000.25,)], "ts double")
    lines = [r[0] for r in df.select(clock.format_line(F.col("ts"), F.lit("hello"))).collect()]
    assert lines == ["[2023-03-28T10:40:00+00:00] hello", "[2023-03-28T10:40:00.250000+00:00] hello"]
    assert column(spark, lines, clock.line_ts) == [1680000000.0, 1680000000.25]


def test_alias_detection_ignores_case():
    names = ["Timestamp", "Service_Name", "Log_Message"]
    assert aliases_in(names, ["time", "timestamp"]) == ["Timestamp"]
    assert aliases_in([*names, "app"], ["app", "service_name"]) == ["app", "Service_Name"]
    assert aliases_in(names, ["body"]) == []


def test_keyword_is_first_in_list_order(spark):
    lines = ["Exception: fatal thing", "FAILED to start", "kernel PANIC", "NullPointerException", "all good", "no such file here"]
    assert column(spark, lines, text.match_keyword) == ["fatal", "fail", "panic", "exception", None, "no such file"]


def test_continuation(spark):
    lines = ["    at a.b(C.java:1)", "\tx", "Caused by: y", "", "   ", "normal", 'File "x.py"', "goroutine 7 [running]:"]
    assert column(spark, lines, text.is_continuation) == [True, True, True, False, False, False, True, True]


def test_mask_and_tokens(spark):
    line = "2024-01-02 03:04:05.5 from 10.0.0.1 id=0f8fad5b-d9cb-469f-a165-70867728950e n:42 é5"
    assert column(spark, [line], text.mask_line) == ["<<TIMESTAMP>> from <<IP>> id=<<UUID>> n:<<NUM>> é5"]
    assert column(spark, [line], text.signature) == ["<<TIMESTAMP>> from <<IP>> id <<UUID>> n <<NUM>> é5"]


@pytest.mark.parametrize(
    "name,query,service",
    [
        ("cartservice/container_memory_bytes", "", "cartservice"),
        ('container_memory_usage_bytes{name="paymentservice"}', "", "paymentservice"),
        ("http_requests_total", "sum(x{app='frontend'})", "frontend"),
        ("frontend_latency", "", "frontend"),
        ("node_cpu", "", "system"),
        ("uptime", "", "system"),
    ],
)
def test_metric_service(spark, name, query, service):
    df = spark.createDataFrame([(name, query)], "n string, q string")
    assert df.select(naming.metric_service(F.col("n"), F.col("q"))).first()[0] == service


def test_truth_from_id(spark):
    ids = ["re2ob_checkout_cpu_1", "re1_tt_order_loss_2", "odd"]
    got = column(spark, ids, naming.truth_from_id)
    assert [(g.service, g.fault_upper, g.benchmark, g.dataset) for g in got] == [
        ("checkout", "CPU", "unknown", "re2ob"), ("order", "LOSS", "tt", "re1"), ("unknown", None, "unknown", "odd"),
    ]


def test_fault_category_and_buckets(spark):
    assert column(spark, [" mem ", "Delay", "odd", None], naming.fault_category) == [K.EC1, K.EC2, K.UNKNOWN_CATEGORY, K.UNKNOWN_CATEGORY]
    df = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "a boolean, b boolean, c boolean")
    got = {(r.a, r.b, r.c): r.o for r in df.withColumn("o", naming.error_bucket(F.col("a"), F.col("b"), F.col("c"))).collect()}
    assert got[(True, True, True)] == "hit"
    assert got[(True, True, False)] == "category_miss"
    assert got[(False, True, True)] == "ranking_miss"
    assert got[(False, False, True)] == "localization_miss"
    assert got[(False, True, False)] == got[(False, False, False)] == "localization_and_category_miss"


def test_span_error_rules(spark):
    rows = [
        (0, [("error", "true")], []),
        (1, [("http.status_code", "503"), ("status_code", "200")], []),
        (2, [("grpc.status_code", "14")], []),
        (3, [("http.status_code", "abc")], []),
        (4, [], [([("message", "boom")],)]),
        (5, [("Exception.Type", "X"), ("message", "m1"), ("error.message", "m2")], []),
        (6, [], [([("event", "Error")],)]),
    ]
    df = spark.createDataFrame(rows, f"i int, tags {spans.TAGS}, logs {spans.SPAN_LOGS}")
    got = [tuple(r.e) for r in df.orderBy("i").select(spans.span_error(F.col("tags"), F.col("logs")).alias("e")).collect()]
    assert got == [
        (True, None, None, None), (True, 200, None, None), (True, 14, None, None), (False, None, None, None),
        (True, None, None, "boom"), (False, None, "X", "m2"), (True, None, None, None),
    ]


def test_status_tags_differ_by_format(spark):
    has_error = lambda fmt: lambda c: F.exists(spans.status_tags(c, fmt), lambda t: t["key"] == "error")
    assert column(spark, ["failed", "1", "200"], has_error("parquet")) == [False, True, False]
    assert column(spark, ["failed", "1", "200"], has_error("csv")) == [True, True, False]


def test_fixed_rounds_like_printf(spark):
    values = [0.125, 2.675, -0.004, 12.345, 1e9 + 0.5]
    assert column(spark, values, lambda c: text.fixed(c, 2), "double") == ["%.2f" % v for v in values]


def test_truncate_keeps_short_text(spark):
    assert column(spark, ["short"], lambda c: text.truncate_tokens(c, F.lit(100))) == ["short"]
    (cut,) = column(spark, ["x" * 1000], lambda c: text.truncate_tokens(c, F.lit(100)))
    assert cut == "x" * 264 + K.TRUNCATED_SUFFIX and len(cut) // 3 <= 100
