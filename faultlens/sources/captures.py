"""Landed captures of monitoring back ends: metric matrices, trace documents, container logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import clock, text
from faultlens.sources import documents
from faultlens.sources.snapshots import TRACE, TRACES, explode_traces

MATRIX = "metric_name string, query string, data array<struct<metric:map<string,string>,values:array<array<string>>>>"
LABELS = "metric_name string, query string, data array<struct<metric:map<string,string>,values:array<string>>>"
SERVICE_LABELS = (
    "container_label_com_docker_compose_service", "service", "service_name", "app", "pod", "container", "name",
)
END_SLACK_SECONDS = 5.0


def _path():
    return F.url_decode(F.col("_metadata.file_path"))


def _case():
    """Case id from `case_id=<case>/` anywhere in the path, else the folder the file lies in."""
    named = F.nullif(F.regexp_extract(_path(), r"/case_id=([^/]+)/", 1), F.lit(""))
    return F.coalesce(named, F.regexp_extract(_path(), r"([^/]+)/[^/]+$", 1))


def _documents(spark: SparkSession, glob: str, schema: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", str(multi_line).lower())
    return reader.json(glob).withColumn("case_id", _case())


def _pieces(spark: SparkSession, glob: str, end: str) -> DataFrame:
    return spark.read.option("lineSep", end).text(glob).withColumn("case_id", _case())


def read_promql_matrix(spark: SparkSession, glob: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """Points of range-query results: one row per value, named `service/metric` when a label tells the service.

    A file is one document, or one document per line with `multi_line=False`. With `split` a file is one document whose
    points are spread over tasks.
    """
    if split:
        docs, arrays = documents.split_arrays(_pieces(spark, glob, "]"))
        docs = docs.select("case_id", documents.DOC, F.from_json("value", LABELS).alias("d")).select("case_id", documents.DOC, "d.*")
    else:
        docs = _documents(spark, glob, MATRIX, multi_line)
    keys = ["case_id", documents.DOC] if split else ["case_id"]
    series = docs.select(*keys, "metric_name", "query", F.explode("data").alias("d"))
    service = F.coalesce(*[F.try_element_at("d.metric", F.lit(x)) for x in SERVICE_LABELS])
    name = F.when(service.isNull(), F.col("metric_name")).otherwise(F.concat(service, F.lit("/"), F.col("metric_name")))
    if split:
        point = lambda c: F.from_json(c, "array<string>")
        marked = F.coalesce(F.get("d.values", F.lit(0)) == documents.MARK, F.lit(False))
        named = series.select(*keys, name.alias("metric_name"), "query", F.col("d.values").alias("pts"), marked.alias("marked"))
        number = lambda i: F.get("pts", F.lit(i)).try_cast("bigint")
        runs = named.filter("marked").withColumns({documents.RUN: number(1), "start": number(2)})
        spread = runs.join(arrays.withColumn("p", point("value")), [documents.DOC, documents.RUN])
        spread = spread.withColumn("seq", F.col("place") - F.col("start"))
        kept = named.filter("NOT marked").select("case_id", "metric_name", "query", F.posexplode("pts").alias("seq", "p"))
        points = spread.select(*kept.columns).unionByName(kept.withColumn("p", point("p")))
    else:
        points = series.select("case_id", name.alias("metric_name"), "query", F.posexplode("d.values").alias("seq", "p"))
    return points.select(
        "case_id", "metric_name", "query",
        clock.parse_ts(F.get("p", F.lit(0))).alias("ts"),
        F.get("p", F.lit(1)).try_cast("double").alias("value"),
        F.col("seq").cast("bigint").alias("seq"),
    ).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())


def read_trace_json(spark: SparkSession, glob: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """Spans of trace documents; a span captured by several requests is kept once.

    A file is one document, or one document per line with `multi_line=False`. With `split` a file is one document whose
    traces are spread over tasks.
    """
    if split:
        objects = documents.split_objects(_pieces(spark, glob, "}"))
        traces = objects.select("case_id", F.from_json("value", TRACE).alias("t"))
    else:
        traces = _documents(spark, glob, f"data {TRACES}", multi_line).select("case_id", F.explode("data").alias("t"))
    return explode_traces(traces.select("case_id", "t.*")).dropDuplicates(["case_id", "trace_id", "span_id"])


def read_container_logs(spark: SparkSession, glob: str, windows: DataFrame | None = None) -> DataFrame:
    """Lines of <case>/<service>.log files (or case_id=…/service=… folders), blanks removed.

    With `windows(case_id, start_ts, end_ts)` lines outside the window are dropped; its end has five
    seconds of slack. Lines without an instant are kept.
    """
    named = F.nullif(F.regexp_extract(_path(), r"/service=([^/]+)/", 1), F.lit(""))
    lines = (
        spark.read.text(glob)
        .select(
            _case().alias("case_id"),
            F.coalesce(named, F.regexp_extract(_path(), r"([^/]+)\.[^./]+$", 1)).alias("service"),
            text.strip(F.col("value")).alias("line"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .filter(F.col("line") != "")
        .withColumn("ts", clock.parse_ts(F.nullif(F.regexp_extract("line", r"^(\d{4}-\d{2}-\d{2}T\S+)", 1), F.lit(""))))
        .withColumn("ts", F.nullif("ts", F.lit(0.0)))
    )
    if windows is None:
        return lines
    inside = F.col("ts").between(F.col("start_ts"), F.col("end_ts") + END_SLACK_SECONDS)
    return lines.join(windows, "case_id").filter(F.col("ts").isNull() | inside).drop("start_ts", "end_ts")
