"""Stored results: snapshots, scores, artifacts; writers, readers and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import naming
from faultlens.operators.evaluation import newest

CASE_MODE = ["case_id", "mode"]
SCORES = (
    "case_id string, ground_truth_service string, predicted_service string, ranked_candidates string, "
    "ground_truth_fault string, predicted_category string, top1_hit string, top3_hit string, mrr string, "
    "fault_match string, confidence string, prompt_tokens string, duration_ms string, engine_type string, mode string"
)


def write_snapshots(signals: dict[str, DataFrame], truth: DataFrame, path: str) -> None:
    """Telemetry and ground truth as JSON lines, one folder per signal and case.

    A case is never gathered into one document: its rows stay spread over as many files as tasks wrote.
    """
    for name, df in {**signals, "ground_truth": truth}.items():
        df.write.mode("overwrite").partitionBy("case_id").json(f"{path}/{name}")


def append_scores(scores: DataFrame, path: str) -> None:
    """Append score rows as CSV per mode; names are joined by semicolons."""
    flat = scores.withColumn("ranked_candidates", F.array_join("ranked_candidates", ";"))
    want = [c.split()[0] for c in SCORES.split(", ")]
    missing = {"prompt_tokens": F.lit(0), "duration_ms": F.lit(0.0), "engine_type": F.lit(K.LOCAL_ENGINE)}
    for c, v in missing.items():
        if c not in flat.columns:
            flat = flat.withColumn(c, v)
    flat.select(*want).write.mode("append").partitionBy("mode").options(header="true", quote='"', escape='"').csv(path)


def parse_scores(raw: DataFrame) -> DataFrame:
    """Text score rows → typed rows; unreadable numbers become zero."""
    flag = lambda c: F.lower(F.coalesce(c, F.lit(""))) == "true"
    number = lambda c, t: F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t))
    names = F.filter(F.split(F.coalesce("ranked_candidates", F.lit("")), ";"), lambda s: s != "")
    d = raw.withColumns(
        {
            "case_id": F.trim("case_id"),
            "ranked_candidates": names,
            **{c: flag(F.col(c)) for c in ("top1_hit", "top3_hit", "fault_match")},
            **{c: number(c, "double") for c in ("mrr", "confidence", "duration_ms")},
            "prompt_tokens": number("prompt_tokens", "bigint"),
        }
    )
    bucket = naming.error_bucket(F.col("top1_hit"), F.col("top3_hit"), F.col("fault_match"))
    return d.filter(F.col("case_id") != "").withColumn("error_bucket", bucket)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_scores(spark.read.schema(SCORES).options(header="true", quote='"', escape='"', multiLine="true").csv(path))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Replace the artifacts of exactly the (mode, case) pairs at hand; the committer makes it atomic."""
    (
        artifacts.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("mode", "case_id")
        .json(path)
    )


def read_artifacts(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stored artifacts, marked as coming from the cache; filters on mode and case prune folders."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(path)
    return df.withColumns({"case_id": F.col("case_id").cast("string"), "source": F.lit("cache")})


def upsert_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets with the latest row per (case, mode)."""
    return newest(existing.unionByName(new, allowMissingColumns=True))


def insert_missing(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`existing` plus the rows of `new` whose (case, mode) it lacks."""
    return existing.unionByName(new.join(existing, CASE_MODE, "left_anti"), allowMissingColumns=True)


def write_templates(templates: DataFrame, path: str) -> None:
    """Save a set of baseline templates; a run saved again replaces the earlier set."""
    templates.select("template").distinct().write.mode("overwrite").parquet(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("template string").parquet(path)
