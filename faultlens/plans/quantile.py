"""Exact order statistics of groups of any size.

The built-in exact percentile keeps a group's distinct values in one task. Here a mergeable sketch
brackets the wanted rank, only the values inside the bracket are ranked, and everything outside is
counted with the value that is next to the bracket. The sketch errs by at most one in ACCURACY of the
group, the bracket spans five times that, so the wanted rank lies inside or right beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY


def exact_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    fraction: float,
    ranks: dict[str, Callable[[Column], Column]],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group: its size `n`, the values at 1-based `ranks` near `fraction`, and `extra` aggregates; nulls do not count."""
    low, high = max(0.0, fraction - MARGIN), min(1.0, fraction + MARGIN)
    df, extra = df.filter(F.col(value).isNotNull()), extra or {}
    sizes = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, [low, high], ACCURACY).alias("__b"),
        *[e.alias(n) for n, e in extra.items()],
    )
    v = F.col(value)
    zone = F.when(v < F.col("__b")[0], -1).when(v > F.col("__b")[1], 1).otherwise(0)
    cells = (
        df.select(*keys, value)
        .join(sizes.select(*keys, "n", "__b"), keys)
        .groupBy(*keys, "n", zone.alias("__z"), F.when(zone == 0, v).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"), F.max(v).alias("__top"), F.min(v).alias("__bottom"))
    )
    # Of the values below the bracket the last one counts, of those above the first.
    at = F.when(F.col("__z") < 0, F.col("__top")).otherwise(F.col("__bottom"))
    cells = cells.withColumn("__v", at)
    ranked = cells.withColumn("__cum", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")))
    picked = [F.min(F.when(F.col("__cum") >= rank(F.col("n")), F.col("__v"))).alias(name) for name, rank in ranks.items()]
    return sizes.drop("__b").join(ranked.groupBy(*keys).agg(*picked), keys)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Median with the mean of the two middle values for even sizes."""
    out = exact_ranks(
        df,
        keys,
        value,
        0.5,
        {
            "__lo": lambda n: F.floor((n + 1) / F.lit(2)),
            "__hi": lambda n: F.floor(n / F.lit(2)) + 1,
        },
        extra,
    )
    return out.withColumn(name, (F.col("__lo") + F.col("__hi")) / 2.0).drop("__lo", "__hi")
