"""Telemetry views over generic tables.

`events` becomes logs and metric points, `lineitem` with `orders` becomes spans. Every row is used;
both timelines are compressed around one injection instant so that the usual windows cover them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same texts are used by the SQL checks, so they stay plain SQL.
INJECT_SECONDS = 1705708800
BASELINE_SECONDS = 900.0
INCIDENT_SECONDS = 600.0
FAULTS = ("cpu", "mem", "delay", "loss", "disk", "socket", "crash", "corrupt")

CASE_OF_EVENT = "event_id % 8"
CASE_OF_SPAN = "l_orderkey % 8"


def case_id_sql(k: str) -> str:
    names = " ".join(f"WHEN {i} THEN 're2ob_svc3_{f}_{i}'" for i, f in enumerate(FAULTS))
    return f"CASE {k} {names} END"


def fault_sql(k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS)) + " END"


MESSAGE_SQL = """CASE
 WHEN event_type = 'view' AND value < 5 THEN concat('kube-probe GET /healthz took ', CAST(value AS STRING))
 WHEN event_type = 'click' AND value > 60 THEN concat('goroutine ', CAST(user_id AS STRING), ' running value ', CAST(value AS STRING))
 WHEN event_type = 'purchase' AND user_id % 12 = 3 AND value > 50 AND ts >= TIMESTAMP '2024-01-20 00:00:00'
  THEN concat('connection refused by peer svc', CAST(event_id % 12 AS STRING), ' value ', CAST(value AS STRING))
 WHEN event_type = 'error' AND value > 50 THEN concat('Exception: call failed user ', CAST(user_id AS STRING))
 WHEN event_type = 'error' AND value < 2 THEN concat('error unexpected value ', CAST(value AS STRING))
 ELSE concat(event_type, ' user ', CAST(user_id AS STRING), ' value ', CAST(value AS STRING), ' ', props) END"""

METRIC_SQL = """concat('svc', CAST(user_id % 12 AS STRING), '_', CASE event_type
 WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'mem' WHEN 'purchase' THEN 'latency'
 WHEN 'signup' THEN 'mem_limit' ELSE 'error_rate' END)"""

VALUE_SQL = "CASE WHEN event_type IN ('view', 'signup') THEN value * 1000000 ELSE value END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _compressed_us(micros: str, origin_seconds: int, factor: int) -> str:
    return (
        f"CAST({INJECT_SECONDS}000000 + floor(CAST({micros} - {origin_seconds}000000 AS DOUBLE) / {factor}) AS BIGINT)"
    )


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cases(case_id, dataset, inject_time, gt_service, gt_fault, has_logs, has_traces)"""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(f"{CASE_OF_EVENT} AS k")
        .distinct()
        .selectExpr(
            f"{case_id_sql('k')} AS case_id",
            "'RE2-OB' AS dataset",
            f"CAST({INJECT_SECONDS} AS DOUBLE) AS inject_time",
            "'svc3' AS gt_service",
            f"{fault_sql('k')} AS gt_fault",
            "true AS has_logs",
            "k <> 7 AS has_traces",
        )
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw logs(case_id, service, ts, message, seq)"""
    us = _compressed_us("unix_micros(CAST(ts AS TIMESTAMP))", INJECT_SECONDS, 2000)
    return table(spark, sf_dir, "events").selectExpr(
        f"{case_id_sql(CASE_OF_EVENT)} AS case_id",
        "concat('svc', CAST(user_id % 12 AS STRING)) AS service",
        f"CAST({us} AS DOUBLE) / 1000000.0D AS ts",
        f"{MESSAGE_SQL} AS message",
        "event_id AS seq",
    )


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw points(case_id, metric_name, query, ts, value, seq)"""
    us = _compressed_us("unix_micros(CAST(ts AS TIMESTAMP))", INJECT_SECONDS, 2000)
    return table(spark, sf_dir, "events").selectExpr(
        f"{case_id_sql(CASE_OF_EVENT)} AS case_id",
        f"{METRIC_SQL} AS metric_name",
        f"concat('case:', {METRIC_SQL}) AS query",
        f"CAST({us} AS DOUBLE) / 1000000.0D AS ts",
        f"CAST({VALUE_SQL} AS DOUBLE) AS value",
        "event_id AS seq",
    )


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in raw file form: one row per line item, parents by halving the ordinal."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    us = _compressed_us("unix_micros(CAST(o_orderdate AS TIMESTAMP))", 915148800, 250000)
    late = "o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'"
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            "*",
            "CAST(row_number() OVER (PARTITION BY l_orderkey"
            " ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS r",
        )
        .selectExpr(
            f"{case_id_sql(CASE_OF_SPAN)} AS case_id",
            "CAST(l_orderkey AS STRING) AS trace_id",
            "concat(CAST(l_orderkey AS STRING), '_', CAST(r AS STRING)) AS span_id",
            "CASE WHEN r > 1 THEN concat(CAST(l_orderkey AS STRING), '_', CAST(CAST(floor(r / 2) AS BIGINT) AS STRING)) END"
            " AS parent_id",
            "concat('svc', CAST(l_suppkey % 12 AS STRING)) AS service",
            "concat(l_linestatus, l_returnflag) AS operation",
            f"{us} + r * 1000 AS start_us",
            f"CAST(l_quantity * 10000 * CASE WHEN l_suppkey % 12 = 3 AND {late} THEN 8 ELSE 1 END AS BIGINT) AS duration_us",
            f"CASE WHEN l_returnflag = 'R' AND l_suppkey % 12 = 3 AND {late} THEN 504 ELSE 200 END AS status",
            f"l_returnflag = 'A' AND l_suppkey % 12 = 3 AND {late} AND l_tax > 0.06 AS logged_timeout",
            "r AS seq",
        )
    )


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans as the trace operators take them, before phases are labelled."""
    from faultlens.functions.spans import SPAN_LOGS, TAGS, status_tags

    raw = raw_spans(spark, sf_dir)
    named = F.array(
        F.struct(F.lit("service.name").alias("key"), F.col("service").alias("value")),
        F.struct(F.lit("operation.name").alias("key"), F.col("operation").alias("value")),
    )
    note = F.array(
        F.struct(
            F.array(
                F.struct(F.lit("message").alias("key"), F.lit("upstream timeout").alias("value"))
            ).alias("fields")
        )
    )
    return raw.select(
        "case_id",
        "trace_id",
        "span_id",
        "parent_id",
        "service",
        "operation",
        "start_us",
        "duration_us",
        F.concat(named, status_tags(F.col("status"))).cast(TAGS).alias("tags"),
        F.when(F.col("logged_timeout"), note).otherwise(F.array()).cast(SPAN_LOGS).alias("logs"),
        "seq",
    )
