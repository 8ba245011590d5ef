"""Filter interaction audit: what each filter of a chain removes in every order of the chain.

Documents are reduced to masks of the filters they fail, and counted by part and mask in Spark: a part is at most
2^filters rows, however many documents it has. These rows become a decision diagram, one level per filter, whose
leaves carry the counts. Swapping two neighbouring levels rebuilds these two levels only, and a chain of such swaps
passes through all orders of the filters. The all-pass path of an order yields its steps: the fail edge leads to what
the step removes, the pass edge to what it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import join_small, store, texts

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: In the order of their bits.
FILTERS = "ABCDE"
#: What a leaf counts.
WEIGHTS = ["documents", "good", "toxic"]


def own_mask(data: bytes) -> int:
    """Bits of the filters A to D, which look at one text alone (UTF-8)."""
    words = data.split()
    points = len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    upper = len(data) - len(data.translate(None, UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > MAX_UPPER_PERCENT * points) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, mask): the bits of filters A to E for every document.

    E fails where an equal text has a smaller id anywhere in the table, so rows without an id never fail it.
    """
    rows = texts(docs, F.coalesce("lang", F.lit("")).alias("part")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "part", F.unhex(F.sha2("text", 256)).alias("text_key"), F.col("text").cast("binary").alias("data")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = pa.array([own_mask(x) for x in rows["data"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["part"], rows["text_key"], own], ["doc_id", "part", "text_key", "own"])

    own = store(rows.mapInArrow(scan, "doc_id long, part string, text_key binary, own int"), "audit-own")
    ids = F.struct(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).alias("ids")
    copies = own.groupBy("text_key").agg(ids).filter("ids.lo < ids.hi").select("text_key", F.col("ids.lo").alias("lo"))
    joined = join_small(own, store(copies, "audit-copies"), ["text_key"], "left")
    late = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))
    return joined.select("doc_id", "part", "text_key", (F.col("own") + F.when(late, 16).otherwise(0)).alias("mask"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): at most 32 rows of a part.

    A document is good or toxic if one of its labels says so; labels without an id belong to nobody.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    joined = join_small(masked(docs), store(marks, "audit-labels"), ["doc_id"], "left", 32)
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("documents"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


class Diagram:
    """A reduced decision diagram over failure masks with counts of documents at its leaves.

    A node is (pass child, fail child); level k tests the filter `order[k]`. Nodes below the last level are leaves,
    the counts themselves. Equal nodes of a level are one; `sums` holds what lies below a node, so a path can be read
    without going down.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.width = len(next(iter(counts.values())))
        zero = (0,) * self.width
        level = [counts.get(mask, zero) for mask in self._masks(filters)]
        self.levels: list[list[tuple]] = []
        self.sums: list[list[tuple[int, ...]]] = []
        self.leaves, refs = self._unique(level)
        below = self.leaves
        for _ in range(filters):
            nodes, refs = self._unique(list(zip(refs[::2], refs[1::2], strict=True)))
            self.levels.insert(0, nodes)
            self.sums.insert(0, self._summed(nodes, below))
            below = self.sums[0]

    @staticmethod
    def _masks(filters: int) -> list[int]:
        """Masks from left to right at the bottom of a diagram that tests bit 0 first."""
        return [sum(1 << k for k in range(filters) if i >> (filters - 1 - k) & 1) for i in range(1 << filters)]

    @staticmethod
    def _unique(items: list[tuple]) -> tuple[list[tuple], list[int]]:
        at: dict[tuple, int] = {}
        refs = [at.setdefault(x, len(at)) for x in items]
        return list(at), refs

    @staticmethod
    def _summed(nodes: list[tuple], below: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        return [tuple(a + b for a, b in zip(below[x], below[y], strict=True)) for x, y in nodes]

    def _below(self, k: int) -> list[tuple[int, ...]]:
        return self.sums[k + 1] if k + 1 < len(self.levels) else self.leaves

    def swap(self, k: int) -> None:
        """Exchange the levels k and k + 1: of the four grandchildren of a node the middle two change places.

        The nodes above keep their places and what lies below the two levels is not touched.
        """
        low = self.levels[k + 1]
        pairs = [(low[a], low[b]) for a, b in self.levels[k]]
        swapped = [x for (pp, pf), (fp, ff) in pairs for x in ((pp, fp), (pf, ff))]
        self.levels[k + 1], refs = self._unique(swapped)
        self.levels[k] = list(zip(refs[::2], refs[1::2], strict=True))
        self.sums[k + 1] = self._summed(self.levels[k + 1], self._below(k + 1))
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) at each step of the present order, along the path of documents that pass."""
        at, out = 0, []
        for k, nodes in enumerate(self.levels):
            passed, failed = nodes[at]
            below = self._below(k)
            out.append((below[passed], below[failed]))
            at = passed
        return out


def orders_by_swaps(n: int) -> Iterator[int | None]:
    """First None for the order at hand, then levels k to swap with k + 1, until all orders have been met once.

    The plain changes of bell ringers: the last item walks through each order of the others, to and fro.
    """
    yield None
    if n < 2:
        return
    at_end = True
    rest = orders_by_swaps(n - 1)
    next(rest)
    while True:
        yield from range(n - 2, -1, -1) if at_end else range(n - 1)
        at_end = not at_end
        step = next(rest, None)
        if step is None:
            return
        # The walker stands before the others or behind them.
        yield step if at_end else step + 1


def audit_part(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, all orders."""
    n = len(filters)
    diagram = Diagram(counts, n)
    found, fails, alone, shapley = [], [0] * n, [0] * n, [0] * n
    for k in orders_by_swaps(n):
        if k is not None:
            diagram.swap(k)
        steps, order = diagram.steps(), list(diagram.order)
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for f, (_, removed) in zip(order, steps, strict=True):
            shapley[f] += removed[0]
        found.append((order, steps))
    return [
        ("".join(filters[f] for f in order), i + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
        for order, steps in found
        for i, (f, (kept, removed)) in enumerate(zip(order, steps, strict=True))
    ]


COLUMNS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language), order of the five filters and step, zeros included.

    kept and removed count the documents after and at the step, redundant those that fail its filter but went before,
    unique_fails those that fail no other filter, shapley what its filter removes summed over all orders. A null text
    is the empty one and a null language the empty part; repeated rows count as often as they are there; an empty
    table gives no rows; extra columns of both tables are ignored.
    """

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r[0]): tuple(int(x) for x in r[1:]) for r in rows[["mask", *WEIGHTS]].itertuples(index=False, name=None)}
        out = pd.DataFrame(audit_part(counts), columns=[c.split()[0] for c in COLUMNS.split(", ")])
        out.insert(0, "part", key[0])
        return out

    return counted(docs, labels).groupBy("part").applyInPandas(each, "part string, " + COLUMNS)
