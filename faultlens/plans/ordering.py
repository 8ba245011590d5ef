"""Running values over long ordered groups, computed in bounded pieces.

A plain window over (case, service) puts a whole group into one task. Here each group is cut into
chunks of its order; a chunk is the window partition, and what earlier chunks contribute comes from
a small table with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.plans.materialize import materialize

CHUNK_LINES = 100_000
_CHUNK = "__chunk"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    prior_max: dict[str, Column] | None = None,
    upto_max: dict[str, Column] | None = None,
    store: str = "running",
) -> DataFrame:
    """Add running sums and maxima in `order` within `keys`; `chunk` must not decrease along `order`.

    `sums` (of values that are never negative) and `upto_max` include the current row, `prior_max` stops
    before it. The values within chunks are written once, as `store`, so a costly `df` runs only once.
    """
    sums, prior_max, upto_max = sums or {}, prior_max or {}, upto_max or {}
    maxima = [*prior_max, *upto_max]
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    chunked = df.withColumn(_CHUNK, chunk)
    inside = materialize(
        chunked.select(
            "*",
            *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
            *[F.max(e).over(before).alias(n) for n, e in prior_max.items()],
            *[F.max(e).over(upto).alias(n) for n, e in upto_max.items()],
            *[F.max(e).over(upto).alias(f"__u_{n}") for n, e in prior_max.items()],
        ),
        store,
    )
    totals = [F.max(n).alias(n) for n in (*sums, *upto_max)] + [F.max(f"__u_{n}").alias(n) for n in prior_max]
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        inside.groupBy(*keys, _CHUNK)
        .agg(*totals)
        .select(
            *keys,
            _CHUNK,
            *[F.sum(n).over(earlier).alias(f"__c_{n}") for n in sums],
            *[F.max(n).over(earlier).alias(f"__c_{n}") for n in maxima],
        )
    )
    added = {n: F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    added |= {n: F.greatest(F.col(n), F.col(f"__c_{n}")) for n in maxima}
    return inside.join(carried, [*keys, _CHUNK]).withColumns(added).select(*df.columns, *added)


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """0-based position of each row in `order` within `keys`."""
    out = running(df, keys, order, chunk, sums={name: F.lit(1).cast("bigint")}, store="numbered")
    return out.withColumn(name, F.col(name) - 1)


def line_chunk(position: str = "line_no") -> Column:
    """Chunk of a dense position: bounded by construction."""
    return F.floor(F.col(position) / F.lit(CHUNK_LINES))
