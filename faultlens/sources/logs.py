"""Log scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import text
from faultlens.sources import aliases as A
from faultlens.sources.bounds import Bounds

LOGS = "case_id string, service string, ts double, message string, seq bigint"


def read_logs(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    layout: str = "folders",
    multi_line: bool = True,
    keep_untimed: bool = False,
    within: Bounds | None = None,
) -> DataFrame:
    """logs(case_id, service, ts, message, seq) of all cases; columns are found by alias, file by file.

    `fmt` "auto" takes the Parquet file of a case, else its CSV file. A null or blank service becomes
    `unknown_service`. Rows without a readable instant are dropped, or kept with a null `ts` for those who count
    them. `seq` keeps the order of the file for rows of the same instant. CSV messages may span lines; files without
    such messages are split among tasks with `multi_line=False`.

    `within` keeps the rows of its cases and instants only: other folders are not opened, and Parquet row groups are
    passed over by their time columns, numbers or instants (times in text, and CSV, are read and then dropped).
    """
    if within is not None and keep_untimed:
        raise ValueError("rows without an instant lie in no bounds")
    if fmt == "auto":
        return A.prefer(*[_if_any(spark, root, f, layout, multi_line, keep_untimed, within) for f in ("parquet", "csv")])
    csv = fmt == "csv"
    wanted = {"time": K.LOG_TIME_CSV if csv else K.LOG_TIME, "service": K.LOG_SERVICE_CSV if csv else K.LOG_SERVICE, "message": K.LOG_MESSAGE}
    df, at = A.scan_columns(spark, root, f"logs.{fmt}", fmt, layout, wanted, ("time", "message"), multi_line, within=within)
    if not at["time"] or not at["message"]:
        return spark.createDataFrame([], LOGS)
    rows = df.select(
        "case_id",
        F.coalesce(F.nullif(text.strip(A.first_of(at["service"])), F.lit("")), F.lit(K.UNKNOWN_SERVICE)).alias("service"),
        A.instant(df, at["time"]).alias("ts"),
        text.strip(F.coalesce(A.first_of(at["message"]), F.lit(""))).alias("message"),
        F.col(A.ROW).alias("seq"),
    )
    if within is not None:
        return rows.filter(within.of_instants(F.col("ts")))
    return rows if keep_untimed else rows.filter(F.col("ts").isNotNull())


def _if_any(spark: SparkSession, root: str, fmt: str, *how) -> DataFrame:
    try:
        return read_logs(spark, root, fmt, *how)
    except AnalysisException as e:
        if not A.missing(e):
            raise
        return spark.createDataFrame([], LOGS)
