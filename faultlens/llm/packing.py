"""Mixture-controlled packing: every window holds the target share of each source.

The documents of a source form a queue of tokens. Deficit round-robin serves, token by token, the queue that lags
most behind its share; what a window owes a queue is carried to the next one. The order is that of the instants
(j + 1/2) / weight over all tokens j of all queues, so what a queue has been served after any number of tokens has a
closed form, and every task cuts its own documents without seeing the others: deficits carry across windows and
across partitions. A queue that runs dry leaves its share to the rest in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import join_small, store, texts

WINDOW = 2048
END_ID = 1
#: Sources are the parts of a mixture that somebody states weights for; their list is held by every task.
MAX_SOURCES = 100_000

TOKENS = "part int, source string, queue_at long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def _encoder(tokenizer_path: str, ranks_path: str | None):
    """texts -> lists of ids, as the tokenizer file gives them without adding special tokens.

    With `ranks_path`, the same vocabulary as ranks, a faster library encodes; texts that spell a special token
    stay with the tokenizer file, which alone knows how to read them.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    encode = lambda text: own.encode(text, add_special_tokens=False).ids
    if ranks_path is None:
        return encode
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    return lambda text: encode(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def tokenize(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per document with its ids (little-endian unsigned 32-bit, `end_id` last) and its place in its queue.

    `queue_at` counts the tokens of the source before it within the same task, `part` names the task.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, ids_of = TaskContext.get().partitionId(), {}, _encoder(tokenizer_path, ranks_path)
        for rows in batches:
            out = []
            for doc_id, text, source in zip(rows["doc_id"], rows["text"], rows["source"], strict=True):
                ids = np.asarray([*ids_of(text), end_id], "<u4")
                source = None if source is None or source != source else source
                out.append((part, source, seen.get(source, 0), None if pd.isna(doc_id) else int(doc_id), len(ids), ids.tobytes()))
                seen[source] = seen.get(source, 0) + len(ids)
            yield pd.DataFrame(out, columns=["part", "source", "queue_at", "doc_id", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})

    return texts(docs, "source").mapInPandas(encode, TOKENS)


class Shares:
    """What every queue has been served when a number of windows is full."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int):
        self.totals, self.weights, self.window = totals, weights, window
        self.all, self.end = int(totals.sum()), float((totals / weights).max()) + 1 if len(totals) else 0.0
        self.blocks: dict[int, np.ndarray] = {}

    def count(self, v: np.ndarray) -> np.ndarray:
        """Tokens of each queue up to the instants v."""
        return np.minimum(np.floor(v[:, None] * self.weights + 0.5).astype(np.int64), self.totals)

    def served(self, windows: np.ndarray) -> np.ndarray:
        target = np.minimum(windows.astype(np.int64) * self.window, self.all)
        lo, hi = np.zeros(len(windows)), np.full(len(windows), self.end)
        for _ in range(200):
            mid = (lo + hi) / 2
            if ((mid <= lo) | (mid >= hi)).all():
                break
            low = self.count(mid).sum(axis=1) <= target
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        at, jump = self.count(lo), self.count(hi) - self.count(lo)
        # Queues that are due at the same instant are served in their order.
        rest = (target - at.sum(axis=1))[:, None] - (np.cumsum(jump, axis=1) - jump)
        return at + np.clip(rest, 0, jump)

    def block(self, k: int, size: int = 256) -> np.ndarray:
        """served() of the windows k * size ... (k + 1) * size; a task walks through few blocks."""
        if k not in self.blocks:
            if len(self.blocks) > 16:
                self.blocks.clear()
            self.blocks[k] = self.served(np.arange(k * size, (k + 1) * size + 1))
        return self.blocks[k]

    def cut(self, q: int, begin: int, end: int, size: int = 256) -> Iterator[tuple[int, int, int, int]]:
        """(window, offset there, first, last + 1) of the pieces of tokens begin ... end of queue q."""
        v = np.array([(begin + 0.5) / self.weights[q]])
        k = int(self.count(v).sum()) // self.window // size
        while k and self.block(k)[0, q] > begin:
            k -= 1
        while begin < end:
            table = self.block(k)
            if table[-1, q] > begin:
                edges = table[:, q]
                i = int(np.searchsorted(edges, begin, side="right")) - 1
                while i < size and begin < end:
                    stop = min(end, int(edges[i + 1]))
                    if stop > begin:
                        before = int((table[i + 1, :q] - table[i, :q]).sum())
                        yield k * size + i, before + begin - int(edges[i]), begin, stop
                        begin = stop
                    i += 1
            k += 1


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    weights: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents (doc_id, text, source), packed without gaps into sequences of `window` tokens.

    `weights` gives the target proportions by source and defaults to the sources' own sizes; every source needs
    one above zero. All sequences but the last are full. A null or empty text is one `end_id`; a null source is a
    queue of its own; null ids and repeated rows are packed like any others; no documents give no pieces.
    """
    tokens = store(tokenize(docs, tokenizer_path, ranks_path, end_id), "packing-tokens")
    sums = tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = store(sums.withColumn("queue_from", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "packing-queues")

    per_source = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_first()).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; state the mixture over fewer")
    names = [r["source"] for r in per_source]
    if weights is not None and any(not weights.get(s, 0) > 0 for s in names):
        raise ValueError("every source needs a weight above zero")
    totals = np.array([r["n"] for r in per_source], np.int64)
    shares = np.array([float(weights[s]) for s in names]) if weights is not None else totals.astype(float)
    queue_of = {s: i for i, s in enumerate(names)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Shares(totals, shares / shares.sum(), window)
        for rows in batches:
            out = []
            for doc_id, source, n, at, ids in zip(rows["doc_id"], rows["source"], rows["doc_tokens"], rows["queue_at"], rows["ids"], strict=True):
                source = None if source is None or source != source else source
                for w, offset, a, b in plan.cut(queue_of[source], at, at + n):
                    out.append((doc_id, a - at, b - a, n, w, offset, source, ids[4 * (a - at) : 4 * (b - at)]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"]).astype({"doc_id": "Int64"})

    # Null sources join too.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("queue")
    placed = join_small(
        tokens.select("part", key, "source", "queue_at", "doc_id", "doc_tokens", "ids"), sums.select("part", key, "queue_from"), ["part", "queue"], "inner"
    )
    return placed.select(
        "doc_id", "source", "doc_tokens", (F.col("queue_at") + F.col("queue_from")).alias("queue_at"), "ids"
    ).mapInPandas(cut, PIECES)
