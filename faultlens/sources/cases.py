"""Case facts: injection instants, registry, file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions import clock, text
from faultlens.sources import aliases as A


def read_inject_times(spark: SparkSession, root: str, layout: str = "folders") -> DataFrame:
    """(case_id, inject_time) from inject_time.txt."""
    raw = A.scan(spark, root, "inject_time.txt", "text", layout, wholetext="true")
    return raw.select("case_id", clock.parse_ts(text.strip(F.col("value"))).alias("inject_time"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows with a normalised `case_id` (from case, case_id or id); rows without one are left out."""
    fmt = "csv" if path.rstrip("/").endswith(".csv") else "parquet"
    df = spark.read.format(fmt).options(**({"header": "true", "quote": '"', "escape": '"', "multiLine": "true"} if fmt == "csv" else {})).load(path)
    have = {c: F.col(f"`{c}`").cast("string") for c in df.columns}

    def first(*names: str):
        found = [have[n] for n in names if n in have]
        return found[0] if found else F.lit("")

    flag = lambda n: F.lower(have[n]).isin("true", "1") if n in have else F.lit(True)
    out = df.select(
        first("case", "case_id", "id").alias("case_id"),
        first("dataset").alias("dataset"),
        first("root_cause_service", "service").alias("gt_service"),
        first("fault", "fault_type").alias("gt_fault"),
        first("system", "benchmark").alias("benchmark"),
        flag("has_logs").alias("has_logs"),
        flag("has_traces").alias("has_traces"),
    )
    return out.filter(F.coalesce("case_id", F.lit("")) != "")


def list_files(spark: SparkSession, root: str, layout: str = "folders") -> DataFrame:
    """(case_id, file_name, size_bytes) of every case file; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.url_decode("path")
    if layout == "partitioned":
        found = files.select(
            F.regexp_extract(path, r"/case_id=([^/]+)/", 1).alias("case_id"),
            F.regexp_extract(path, r"/([^/]+)/case_id=", 1).alias("file_name"),
            F.col("length").alias("size_bytes"),
        )
    else:
        base = r"/([^/]+)/([^/]+\.(?:parquet|txt|csv|json))(?:/part-[^/]*)?$"
        found = files.select(
            F.regexp_extract(path, base, 1).alias("case_id"),
            F.regexp_extract(path, base, 2).alias("file_name"),
            F.col("length").alias("size_bytes"),
        )
    return found.filter(F.col("case_id") != "")
