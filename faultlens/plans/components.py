"""Connected components of a graph given as links, without a vertex whose links meet in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.plans.materialize import materialize


def _are_stars(links: DataFrame) -> bool:
    """Whether every vertex has one link at most to a lesser one, and that one none."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def _stars(links: DataFrame, at: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Links with the least vertex `m` around their end `at`, that end included."""
    least = links.groupBy(at).agg(F.least(F.min(other), F.first(at)).alias("m"))
    return links.join(materialize(least, "stars"), at), least


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the stored links(a, b): the root is the least vertex of its component.

    Each link is given once, from the greater vertex to the lesser.
    Large and small stars by turns: every vertex hands the larger of its neighbours to its least one, then the smaller
    ones, until each component is a star. A round is two groupings with map-side combining and two equality joins,
    whose hot keys Spark may split; long chains halve from round to round.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = _stars(both, "a", "b")
        large = materialize(large.filter("b > a").select(*pair(F.col("b"), F.col("m"))).distinct(), "links")
        small, least = _stars(large, "a", "b")
        moved = small.filter("b <> m").select(*pair(F.col("b"), F.col("m")))
        links = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
