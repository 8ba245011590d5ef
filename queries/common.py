"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import prepare
from faultlens.session import bound_tasks
from faultlens.plans import views
from faultlens.plans.investigation import Investigation

_known: dict[tuple[str, str, str], Investigation] = {}


def investigation(spark: SparkSession, sf_dir: str, template_source: str = "signature") -> Investigation:
    """One investigation per session and data folder, so that evidence is computed once."""
    _sized(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, template_source)
    if key not in _known:
        _known[key] = Investigation(
            views.case_table(spark, sf_dir),
            views.raw_logs(spark, sf_dir),
            views.raw_points(spark, sf_dir),
            views.span_table(spark, sf_dir),
            views.BASELINE_SECONDS,
            views.INCIDENT_SECONDS,
            template_source,
        )
    return _known[key]


def forget() -> None:
    """Drop all shared evidence; timings of single queries need a cold start."""
    _known.clear()


def rounded(*names: str, digits: int = 4) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def rounded_sql(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


def _sized(spark: SparkSession, sf_dir: str) -> SparkSession:
    return bound_tasks(prepare(spark), *[f"{sf_dir}/{n}.parquet" for n in ("events", "orders", "lineitem")])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(_sized(spark, sf_dir), sf_dir, "events")


def plain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_spans(_sized(spark, sf_dir), sf_dir)
