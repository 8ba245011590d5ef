"""Bounds of reads: the same rows as without them, fewer row groups and folders."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from faultlens.operators import windows
from faultlens.sources.bounds import Bounds, bounds_of, united
from faultlens.sources.logs import read_logs
from faultlens.sources.metrics import read_metrics
from faultlens.sources.spans import SPANS
from faultlens.streaming.runs import latest, stream_cases

T = 1_700_000_000
CASES = "case_id string, inject_time double"


def cases(spark):
    return spark.createDataFrame([("a", T + 0.0), ("b", T + 50_000.0)], CASES)


def pushed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    return " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan)), plan


def write_cases(spark, root, stamp, name="Timestamp"):
    """Two cases of 4,000 rows, a second apart each."""
    for case, start in (("a", T - 2000), ("b", T + 48_000)):
        rows = spark.range(4000).select(stamp((F.col("id") + start).cast("double")).alias(name), F.lit("svc").alias("service"), F.concat(F.lit("m"), "id").alias("message"))
        rows.coalesce(1).write.parquet(f"{root}/{case}/logs.parquet")


STAMPS = {
    "seconds": lambda s: s,
    "milliseconds": lambda s: (s * 1e3).cast("long"),
    "nanoseconds": lambda s: (s * 1e9).cast("long"),
    "int": lambda s: s.cast("int"),
    "instant": lambda s: F.timestamp_micros((s * 1e6).cast("long")),
    "text": lambda s: s.cast("decimal(20,3)").cast("string"),
}


@pytest.mark.parametrize("kind", STAMPS)
def test_logs_are_bounded_in_the_scan(spark, tmp_path, kind):
    write_cases(spark, tmp_path, STAMPS[kind])
    within = bounds_of(cases(spark))
    bounded = read_logs(spark, str(tmp_path), within=within)
    plain = windows.label_phase(read_logs(spark, str(tmp_path)), cases(spark))
    same = windows.label_phase(bounded, cases(spark), within=within)
    key = lambda df: sorted((r.case_id, r.message, r.phase) for r in df.collect())
    assert key(same) == key(plain) and bounded.count() == same.count() == 2 * 901
    filters, _ = pushed(bounded)
    assert ("GreaterThanOrEqual(Timestamp" in filters and "LessThanOrEqual(Timestamp" in filters) == (kind != "text")


def test_several_time_columns(spark, tmp_path):
    write_cases(spark, tmp_path, STAMPS["seconds"])
    spark.range(10).select((F.col("id") + T).alias("ts"), F.lit("s").alias("pod"), F.lit("other").alias("body")).write.parquet(f"{tmp_path}/c/logs.parquet")
    within = Bounds(((T + 0.0, T + 4.0),))
    rows = read_logs(spark, str(tmp_path), within=within)
    assert sorted(r.case_id for r in rows.collect()) == ["a"] * 5 + ["c"] * 5
    assert "Or(" in pushed(rows)[0]


def test_metrics_are_bounded_in_the_scan(spark, tmp_path):
    wide = spark.range(4000).select((F.col("id") + T - 2000).alias("time"), F.col("id").cast("double").alias("cpu"), F.lit(None).cast("double").alias("mem"))
    wide.coalesce(1).write.parquet(f"{tmp_path}/a/metrics.parquet")
    within = bounds_of(cases(spark))
    bounded = read_metrics(spark, str(tmp_path), within=within)
    plain = windows.label_phase(read_metrics(spark, str(tmp_path)), cases(spark))
    assert sorted(r.value for r in bounded.collect()) == sorted(r.value for r in plain.collect()) == [float(i) for i in range(1400, 2301)]
    assert "GreaterThanOrEqual(time" in pushed(bounded)[0]


def test_only_wanted_folders_are_opened(spark, tmp_path):
    odd = "we{i,r}d[1]*"
    for case in ("a", odd):
        spark.range(3).select((F.col("id") + T).alias("ts"), F.lit("s").alias("pod"), F.lit(case).alias("body")).write.parquet(f"{tmp_path}/{case}/logs.parquet")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "logs.parquet").write_bytes(b"no parquet")
    within = bounds_of(spark.createDataFrame([("a", T + 0.0), (odd, T + 0.0), ("absent", T + 0.0)], CASES))
    assert sorted((r.case_id, r.message) for r in read_logs(spark, str(tmp_path), within=within).collect()) == [("a", "a")] * 3 + [(odd, odd)] * 3


def test_partitions_of_other_cases_are_not_read(spark, tmp_path):
    rows = spark.range(6).select(F.when(F.col("id") < 3, "a").otherwise("b").alias("case_id"), (F.col("id") + T).alias("ts"), F.lit("m").alias("message"))
    rows.write.partitionBy("case_id").parquet(f"{tmp_path}/logs.parquet")
    bounded = read_logs(spark, str(tmp_path), layout="partitioned", within=Bounds(((0.0, 2.0 * T),), ("a",)))
    assert bounded.count() == 3 and re.search(r"PartitionFilters: \[[^\]]*case_id[^\]]* = a", pushed(bounded)[1])


def test_bounds_of_few_and_many_cases(spark):
    many = spark.range(100).select(F.col("id").cast("string").alias("case_id"), (F.col("id") * 10_000.0).alias("inject_time"))
    exact = bounds_of(many)
    assert len(exact.ranges) == 100 and len(exact.cases) == 100
    assert bounds_of(many, most=99) == Bounds(((-600.0, 990_300.0),))
    nothing = bounds_of(many.filter("false"))
    assert nothing == Bounds((), ()) and many.filter(nothing.of_instants(F.col("inject_time"))).count() == 0
    assert united([(5, 6), (1, 3), (2, 4), (4, 4.5)]) == ((1, 4.5), (5, 6))


def test_untimed_rows_have_no_bounds(spark, tmp_path):
    with pytest.raises(ValueError):
        read_logs(spark, str(tmp_path), keep_untimed=True, within=Bounds(((0.0, 1.0),)))


def test_a_batch_reads_the_folders_of_its_cases_only(spark, tmp_path):
    """Telemetry of a case that has not landed may be anything, such as half a file."""
    root, schema = str(tmp_path / "telemetry"), "case_id string, inject_time double, gt_service string, gt_fault string"
    rows = [(c, s, T + i - 5.0, "fine" if i < 5 else f"error {s}", i) for c in "ab" for i in range(8) for s in ("x", "y")[: 1 + (c == "a")]]
    logs = spark.createDataFrame(rows, "case_id string, service string, ts double, message string, seq long")
    points = spark.createDataFrame([("a", "x_cpu", "q", T + 0.0, 1.0, 1)], "case_id string, metric_name string, query string, ts double, value double, seq long")
    telemetry = []
    for name, df in (("logs", logs), ("points", points), ("spans", spark.createDataFrame([], SPANS))):
        df.write.partitionBy("case_id").parquet(f"{root}/{name}")
        (tmp_path / "telemetry" / name / "case_id=later").mkdir()
        (tmp_path / "telemetry" / name / "case_id=later" / "part-0.parquet").write_bytes(b"half a file")
        telemetry.append(spark.read.schema(df.schema).parquet(f"{root}/{name}"))
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    spark.createDataFrame([("a", T + 0.0, "x", "mem"), ("b", T + 0.0, "x", "mem")], schema).coalesce(1).write.parquet(src)
    stream_cases(spark.readStream.schema(schema).parquet(src), *telemetry, out, ckpt, modes=("logs-only",))
    assert {r.case_id: r.predicted_service for r in latest(spark, out, ["case_id", "mode"]).collect()} == {"a": "x", "b": "x"}
