"""Span scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import spans as S
from faultlens.plans.ordering import numbered
from faultlens.sources import aliases as A

SPANS = (
    "case_id string, trace_id string, span_id string, parent_id string, service string, operation string, "
    f"start_us bigint, duration_us bigint, tags {S.TAGS}, logs {S.SPAN_LOGS}, seq bigint"
)


def clean_ids(df: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Trim parent ids, drop the spellings of "none", and name spans that came without an id `{trace}_{n}`.

    n is the span's place in its trace; long traces are numbered piece by piece (`chunk` follows `order`).
    """
    cleaned = df.withColumn("parent_id", S.clean_parent(F.col("parent_id")))
    placed = numbered(cleaned, ["case_id", "trace_id"], order, chunk, "__n")
    own = F.nullif(F.trim("span_id"), F.lit(""))
    return placed.withColumn(
        "span_id", F.coalesce(own, F.concat("trace_id", F.lit("_"), F.col("__n").cast("string")))
    ).drop("__n")


def read_spans(spark: SparkSession, root: str, fmt: str = "parquet", layout: str = "folders", multi_line: bool = True) -> DataFrame:
    """Spans of all cases in the form the trace operators take; columns are found by alias, file by file.

    `fmt` "auto" takes the Parquet file of a case, else its CSV file. Empty without a time column; rows without a
    readable instant are dropped.
    """
    if fmt == "auto":
        return A.prefer(*[_if_any(spark, root, f, layout, multi_line) for f in ("parquet", "csv")])
    csv = fmt == "csv"
    wanted = K.SPAN_COLUMNS_CSV if csv else K.SPAN_COLUMNS
    df, at = A.scan_columns(spark, root, f"traces.{fmt}", fmt, layout, wanted, ("time", "trace") if csv else ("time",), multi_line, ("duration",))
    if not at["time"] or (csv and not at["trace"]):
        return spark.createDataFrame([], SPANS)

    def column(key: str) -> Column:
        return F.trim(A.first_of(at[key]))

    def default(key: str, value: str) -> Column:
        c = F.nullif(column(key), F.lit("")) if csv else column(key)
        return F.coalesce(c, F.lit(value))

    service, operation = default("service", K.UNKNOWN_SERVICE), default("operation", "unknown_op")
    status = S.status_tags(A.first_of(at["status"]), fmt)
    durations = [F.when(c.isNotNull(), S.duration_us(c, name, fmt)) for name, c in at["duration"]]
    duration = F.coalesce(*durations, F.lit(0).cast("bigint"))
    tag = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    rows = df.select(
        "case_id",
        default("trace", "tr_unknown").alias("trace_id"),
        column("span").alias("span_id"),
        S.clean_parent(column("parent")).alias("parent_id"),
        service.alias("service"),
        operation.alias("operation"),
        (A.instant(df, at["time"]) * 1e6).cast("bigint").alias("start_us"),
        duration.alias("duration_us"),
        F.concat(
            F.array(tag("service.name", service), tag("operation.name", operation)),
            F.coalesce(status, F.array().cast(S.TAGS)),
        ).cast(S.TAGS).alias("tags"),
        F.array().cast(S.SPAN_LOGS).alias("logs"),
        F.col(A.ROW).alias("seq"),
    ).filter(F.col("start_us").isNotNull())
    bare = F.nullif(F.col("span_id"), F.lit("")).isNull()
    if at["span"]:
        # Ids are unique within a scan already; `seq` only has to differ, so no trace is numbered as a whole.
        return rows.withColumn(
            "span_id", F.when(bare, F.concat("trace_id", F.lit("_"), F.col("seq").cast("string"))).otherwise(F.col("span_id"))
        )
    return clean_ids(rows, ["start_us", "seq"], F.floor(F.col("start_us") / F.lit(1_000_000)))


def _if_any(spark: SparkSession, root: str, fmt: str, *how) -> DataFrame:
    try:
        return read_spans(spark, root, fmt, *how)
    except AnalysisException as e:
        if not A.missing(e):
            raise
        return spark.createDataFrame([], SPANS)
