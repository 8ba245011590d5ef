from __future__ import annotations

from faultlens.streaming.buckets import stream_buckets
from faultlens.streaming.dedup import stream_dedup
from faultlens.sources.spans import SPANS
from faultlens.streaming.runs import drain, latest, stream_cases
from queries import streams

SIGNALS = "case_id string, ts double, service string, kind string"
T = 1680000000.0


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_buckets_drop_late_rows(spark, tmp_path):
    cases = spark.createDataFrame([("c", T)], "case_id string, inject_time double")
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: drain(stream_buckets(stream(spark, src, SIGNALS), cases, 5.0, "10 seconds"), out, ckpt)
    land(spark, src, [("c", T - 7, "a", "log"), ("c", T + 1, "b", "span"), ("c", T + 2, "unknown_service", "metric")], SIGNALS)
    run()
    land(spark, src, [("c", T + 100, "a", "log")], SIGNALS)
    run()
    # The bucket at T−10 is final by now: this row is late and must not change it.
    land(spark, src, [("c", T - 8, "z", "log"), ("c", T + 200, "a", "log")], SIGNALS)
    run()
    got = {r.bucket_index: (r.log_count, r.metric_points_count, r.span_count, r.services) for r in spark.read.parquet(out).collect()}
    assert got[-2] == (1, 0, 0, ["a"])
    assert got[0] == (0, 1, 1, ["b"])


def test_dedup_across_runs(spark, tmp_path):
    schema = "case_id string, trace_id string, span_id string, start_us bigint"
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    land(spark, src, [("c", "t", "s1", 1_000_000), ("c", "t", "s2", 1_000_000), ("c", "t", "s1", 1_000_000)], schema)
    drain(stream_dedup(stream(spark, src, schema)), out, ckpt)
    land(spark, src, [("c", "t", "s2", 1_000_000), ("c", "t", "s3", 1_000_000)], schema)
    drain(stream_dedup(stream(spark, src, schema)), out, ckpt)
    assert sorted(r.span_id for r in spark.read.parquet(out).collect()) == ["s1", "s2", "s3"]


def test_cases_are_scored_once_and_replaced_when_they_land_again(spark, tmp_path):
    """Every landing of a case row diagnoses the telemetry of that case anew; other cases are not touched."""
    schema = "case_id string, inject_time double, gt_service string, gt_fault string"
    calm = [(c, s, T - 50 + i, f"fine {s}", i) for c in "ab" for i in range(5) for s in ("x", "y")]
    bad = [(c, s, T + i, f"error: {s} is out of memory {i}", 10 + i) for c, s in (("a", "x"), ("b", "y")) for i in range(3)]
    logs = spark.createDataFrame(calm + bad, "case_id string, service string, ts double, message string, seq long")
    points = spark.createDataFrame([], "case_id string, metric_name string, query string, ts double, value double, seq long")
    spans = spark.createDataFrame([], SPANS)
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: stream_cases(stream(spark, src, schema), logs, points, spans, out, ckpt, modes=("logs-only",))
    land(spark, src, [("a", T, "y", "mem")], schema)
    run()
    land(spark, src, [("a", T, "x", "mem"), ("b", T, "x", "mem")], schema)
    run()
    run()
    got = {r.case_id: (r.predicted_service, r.top1_hit) for r in latest(spark, out, ["case_id", "mode"]).collect()}
    assert got == {"a": ("x", True), "b": ("y", False)}
    assert spark.read.parquet(out).count() == 3


def test_landed_files_stay_small_and_make_two_batches(spark, monkeypatch):
    """Files grow in number with the rows, so that no task reads a fixed share of the whole."""
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    paths, write = [], streams.scratch_path
    monkeypatch.setattr(streams, "scratch_path", lambda s, label: paths.append(write(s, label)) or paths[-1])
    landed = streams._landed(spark, spark.range(95), "few")
    files = spark.read.parquet(paths[0]).groupBy("_metadata.file_path").count().collect()
    assert landed.isStreaming and len(files) == 10 and max(r["count"] for r in files) <= 11
    streams._landed(spark, spark.range(5), "few")
    assert spark.read.parquet(paths[1]).count() == 5


def test_late_landings_take_their_parts_of_signals_written_once(spark, monkeypatch):
    """The telemetry is derived once, not once for each landing."""
    calls, stored = [], []
    derive, store = streams._signals, streams.materialize
    monkeypatch.setattr(streams, "_signals", lambda inv: calls.append(1) or derive(inv).limit(50))
    monkeypatch.setattr(streams, "materialize", lambda df, label: stored.append(label) or store(df, label))
    streams.stream_buckets_late(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1 and stored == ["all-signals"]
