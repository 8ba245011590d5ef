"""Cut lineage with a table in the cluster's shared folder; it survives the loss of any executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from faultlens.session import run_dir


def scratch_path(spark, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = "zstd", **options: str) -> DataFrame:
    """Write a DataFrame once and read it back, so that several consumers share one computation.

    Without `compression` the session's own is taken; `options` are those of Spark's Parquet writer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
