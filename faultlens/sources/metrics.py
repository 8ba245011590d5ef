"""Metric scans: wide columnar files and nested JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import clock
from faultlens.sources import aliases as A
from faultlens.sources import documents
from faultlens.sources.bounds import Bounds

POINTS = "case_id string, metric_name string, query string, ts double, value double, seq bigint"


def _query(name):
    return F.concat(F.lit(K.METRIC_QUERY_PREFIX), name)


def unpivot_metrics(df: DataFrame, within: Bounds | None = None) -> DataFrame:
    """Wide rows (one column per series) → long points; missing values are dropped, and rows that lie in no bounds."""
    time = next((c for c in ("time", "timestamp") if c in df.columns), None)
    names = [c for c in df.columns if c not in (time, "case_id", A.ROW)]
    if time is None or not names:
        return df.sparkSession.createDataFrame([], POINTS)
    wide = A.in_bounds(df, [time], within).select(
        "case_id",
        A.instant(df, [(time, F.col(f"`{time}`"))]).alias("ts"),
        F.col(A.ROW).alias("seq"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in names],
    )
    return (
        wide.unpivot(["case_id", "ts", "seq"], [f"`{c}`" for c in names], "metric_name", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts").isNotNull())
        .select("case_id", "metric_name", _query(F.col("metric_name")).alias("query"), "ts", "value", "seq")
    )


def _series(docs: DataFrame, *keys: str) -> DataFrame:
    """Arrays of points (…, metric_name, pts) of JSON documents in any of the three layouts."""
    spark = docs.sparkSession
    explode = lambda c: spark.tvf.variant_explode(F.col(c).outer())
    kind = lambda c: F.regexp_extract(F.schema_of_variant(F.col(c)), r"^[A-Z]+", 0)
    get = lambda path, typ: F.try_variant_get(F.col("v1"), path, typ)

    # try_parse_json turns a broken document into null instead of failing the job.
    top = (
        docs.select(*keys, F.try_parse_json("value").alias("doc"))
        .filter(F.col("doc").isNotNull())
        .lateralJoin(explode("doc"))
        .select(*keys, F.col("key").alias("k1"), F.col("value").alias("v1"))
        .withColumn("kind", kind("v1"))
    )
    nested = (
        top.filter(F.col("k1").isNotNull() & (F.col("kind") == "OBJECT"))
        .lateralJoin(explode("v1"))
        .select(*keys, F.concat("k1", F.lit("/"), "key").alias("metric_name"), F.col("value").alias("pts"))
    )
    flat = top.filter(F.col("k1").isNotNull() & (F.col("kind") == "ARRAY")).select(
        *keys, F.col("k1").alias("metric_name"), F.col("v1").alias("pts")
    )
    listed = top.filter(F.col("k1").isNull() & (F.col("kind") == "OBJECT")).select(
        *keys,
        F.coalesce(get("$.metric", "string"), get("$.metric_name", "string"), F.lit("unknown")).alias("metric_name"),
        F.coalesce(get("$.values", "variant"), get("$.data", "variant")).alias("pts"),
    )
    series = nested.unionByName(flat).unionByName(listed)
    return series.filter(F.col("pts").isNotNull() & (kind("pts") == "ARRAY"))


def _once(*values: Column) -> list[Column]:
    """Costly values as rows of a generator: filters on them stay above it, so they are not computed again below."""
    return [F.inline(F.array(F.struct(*values)))]


def _as_points(rows: DataFrame) -> DataFrame:
    """Rows (case_id, metric_name, seq, value), the value an array of instant and number, as points."""
    text = F.try_variant_get(F.col("value"), "$[0]", "string").alias("t")
    number = F.try_variant_get(F.col("value"), "$[1]", "double").alias("v")
    return (
        rows.select("case_id", "metric_name", F.col("seq").cast("bigint").alias("seq"), *_once(text, number))
        .select("case_id", "metric_name", "seq", "v", *_once(clock.parse_ts(F.col("t")).alias("ts")))
        .select("case_id", "metric_name", _query(F.col("metric_name")).alias("query"), "ts", "v", "seq")
        .filter(F.col("ts").isNotNull() & F.col("v").isNotNull())
        .select("case_id", "metric_name", "query", "ts", F.col("v").alias("value"), "seq")
    )


def _exploded(series: DataFrame) -> DataFrame:
    points = series.sparkSession.tvf.variant_explode(F.col("pts").outer())
    return _as_points(series.lateralJoin(points).withColumnRenamed("pos", "seq"))


def json_points(docs: DataFrame) -> DataFrame:
    """Points of JSON documents (case_id, value) in any of the three layouts."""
    return _exploded(_series(docs, "case_id"))


def split_json_points(scan: DataFrame) -> DataFrame:
    """The same points of a text scan with `lineSep` "]": a document's points are spread over tasks."""
    docs, points = documents.split_arrays(scan)
    series = _series(docs, "case_id", documents.DOC)
    marked = F.coalesce(F.try_variant_get("pts", "$[0]", "string") == documents.MARK, F.lit(False))
    number = lambda path: F.try_variant_get("pts", path, "bigint")
    runs = series.filter(marked).select(
        "case_id", documents.DOC, "metric_name", number("$[1]").alias(documents.RUN), number("$[2]").alias("start")
    )
    parsed = points.select(documents.DOC, documents.RUN, "place", *_once(F.try_parse_json("value").alias("value")))
    spread = runs.join(parsed, [documents.DOC, documents.RUN]).withColumn("seq", F.col("place") - F.col("start"))
    return _as_points(spread).unionByName(_exploded(series.filter(~marked)))


def read_metrics(
    spark: SparkSession, root: str, fmt: str = "parquet", layout: str = "folders", within: Bounds | None = None
) -> DataFrame:
    """points(case_id, metric_name, query, ts, value, seq) of all cases.

    `fmt` "json" reads one document per case as one row, "json-split" spreads a document over tasks, "jsonl" reads one
    document per line; "auto" takes the Parquet file of a case, else its JSON document. `within` keeps its cases and instants only, as for logs.
    """
    if fmt == "auto":
        return A.prefer(*[_if_any(spark, root, f, layout, within) for f in ("parquet", "json")])
    if fmt == "jsonl":
        points = json_points(A.scan(spark, root, "metrics.jsonl", "text", layout, within=within))
    elif fmt == "json-split":
        points = split_json_points(A.scan(spark, root, "metrics.json", "text", layout, within=within, lineSep="]"))
    elif fmt == "json":
        points = json_points(A.scan(spark, root, "metrics.json", "text", layout, within=within, wholetext="true"))
    else:
        # Cases name different services, so the columns of all files are merged.
        points = unpivot_metrics(A.scan(spark, root, "metrics.parquet", "parquet", layout, within=within, mergeSchema="true"), within)
    return points if within is None else points.filter(within.of_instants(F.col("ts")))


def _if_any(spark: SparkSession, root: str, fmt: str, *how) -> DataFrame:
    try:
        return read_metrics(spark, root, fmt, *how)
    except AnalysisException as e:
        if not A.missing(e):
            raise
        return spark.createDataFrame([], POINTS)
