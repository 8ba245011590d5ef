"""Sinks of the streams: every micro-batch owns one folder, so a repeated batch replaces itself."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.plans.investigation import Investigation
from faultlens.sources.bounds import bounds_of


def _into_batches(path: str, transform=None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append", transform=None) -> None:
    """Process everything that has landed, then stop; the checkpoint remembers what was done."""
    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_into_batches(path, transform))
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all batches."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def own(telemetry: DataFrame, cases: DataFrame) -> DataFrame:
    """The rows of these cases; their ids are literals, so that folders by case are chosen before anything is read."""
    within = bounds_of(cases)
    if within.cases is None:
        return telemetry.join(cases.select("case_id"), "case_id", "left_semi")
    return telemetry.filter(within.of_cases(F.col("case_id")))


def stream_cases(
    landed: DataFrame, logs: DataFrame, points: DataFrame, spans: DataFrame, path: str, checkpoint: str, **settings
) -> None:
    """Diagnose and score newly landed cases; a case that lands again gets a newer result.

    `landed` streams rows of the case table, each written when the telemetry of its case is complete. A batch opens
    the folders of its own cases only, where raw logs, points and spans are partitioned by case: their ids stand in
    its plan. A batch of very many cases joins instead.
    """

    def diagnose(batch: DataFrame) -> DataFrame:
        run = Investigation(batch.dropDuplicates(["case_id"]), logs, points, spans, **settings)
        return replace(run, **{f"raw_{k}": own(df, run.cases) for k, df in (("logs", logs), ("points", points), ("spans", spans))}).scores

    drain(landed, path, checkpoint, transform=diagnose)
