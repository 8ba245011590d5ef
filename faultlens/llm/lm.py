"""LM scoring by masked pseudo-likelihood.

A small network sees the two words on either side of a place and predicts the word there; a document's score is the
sum of the log-probabilities of all its words, each given its neighbours. The network predicts tokens, which are the
corpus' most frequent words by name and all others by what they look like; a word's probability is that of its token
times the word's share in the token, counted over the whole corpus, so the vocabulary holds every word there is.
Training covers the whole corpus: rounds go on until every place was a target, every task trains on its own documents,
and the parameters of all tasks are averaged by the places they saw.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store, texts
from faultlens.plans.materialize import materialize

#: Distinct words and places beyond which a block of documents ends.
BLOCK_WORDS, BLOCK_PLACES = 1 << 19, 1 << 23


class Settings(NamedTuple):
    named: int = 127
    looks: int = 64
    hidden: int = 16
    reach: int = 2
    #: At least so many rounds of training, and more until every place was a target.
    rounds: int = 2
    #: Share of the places that a round masks and predicts.
    masked: float = 0.15
    batch: int = 2048
    rate: float = 0.01
    seed: int = 4

    @property
    def size(self) -> int:
        """Token 0 stands outside of a text."""
        return 1 + self.named + self.looks


    @property
    def turns(self) -> int:
        """Rounds after which every place was a target."""
        return math.ceil(1 / self.masked)


class Vocabulary(NamedTuple):
    """Named words, how often each token stands in the corpus, and (word, n, token) of all its words."""

    named: list[bytes]
    counts: np.ndarray
    words: DataFrame


class Index(dict):
    """Word -> its number, in the order of first places."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Network:
    """tanh of summed context embeddings, one table for each place of the window, then a softmax over tokens."""

    def __init__(self, s: Settings, flat: np.ndarray):
        self.s, self.flat = s, flat.astype(np.float32)
        v, h, c = s.size, s.hidden, 2 * s.reach
        cuts = np.cumsum([c * v * h, h, h * v])
        self.inner = self.flat[: cuts[0]].reshape(c, v, h)
        self.bias = self.flat[cuts[0] : cuts[1]]
        self.outer = self.flat[cuts[1] : cuts[2]].reshape(h, v)
        self.prior = self.flat[cuts[2] :]

    @staticmethod
    def start(s: Settings, counts: np.ndarray) -> np.ndarray:
        """Small random weights; the output bias is the log frequency of every token in the corpus."""
        rng = np.random.default_rng(s.seed)
        weights = rng.normal(0, 0.1, 2 * s.reach * s.size * s.hidden + s.hidden + s.hidden * s.size)
        return np.r_[weights, np.log((counts + 1) / (counts + 1).sum())].astype(np.float32)

    def hide(self, context: np.ndarray) -> np.ndarray:
        """Hidden values of every place, and a last one of 1 that meets the prior."""
        total = np.ones((context.shape[1], self.s.hidden + 1), np.float32)
        inner = np.take(self.inner[0], context[0], axis=0)
        for table, tokens in zip(self.inner[1:], context[1:], strict=True):
            inner += np.take(table, tokens, axis=0)
        np.tanh(inner + self.bias, out=total[:, :-1])
        return total

    def exponentials(self, hidden: np.ndarray) -> np.ndarray:
        """exp of the logits, or of what lies below their maximum where they could overflow."""
        logits = hidden @ np.vstack([self.outer, self.prior])
        if (np.abs(self.outer).sum(axis=0) + np.abs(self.prior)).max() > 60:
            logits -= logits.max(axis=1, keepdims=True)
        return np.exp(logits, out=logits)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        p = self.exponentials(self.hide(context))
        return np.log(p[np.arange(len(target)), target] / (p @ np.ones(self.s.size, np.float32)) + np.float32(1e-30))

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        hidden = self.hide(context)
        p = self.exponentials(hidden)
        total = p @ np.ones(self.s.size, np.float32)
        p[np.arange(len(target)), target] -= total
        share = (1 / (total * len(target)))[:, None]
        own = hidden[:, :-1]
        back = (p @ self.outer.T) * share * (1 - own * own)
        out = Network(self.s, np.zeros_like(self.flat))
        cells = np.arange(self.s.hidden)
        for grad, tokens in zip(out.inner, context, strict=True):  # numpy adds at places of one dimension faster
            np.add.at(grad.reshape(-1), (tokens[:, None] * self.s.hidden + cells).ravel(), back.ravel())
        out.bias += back.sum(axis=0)
        last = (hidden * share).T @ p
        out.outer += last[:-1]
        out.prior += last[-1]
        return out.flat


def contexts(texts: list[np.ndarray], reach: int, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The neighbours of the chosen places of some texts one after the other, one line for each offset."""
    sizes = np.array([len(t) for t in texts])
    gaps = np.repeat(np.arange(1, len(texts) + 1) * reach, sizes)
    at = np.arange(sizes.sum()) + gaps
    padded = np.zeros(sizes.sum() + reach * (len(texts) + 1), np.int32)
    padded[at] = np.concatenate(texts)
    at = at[chosen]
    return np.stack([padded[at + o] for o in range(-reach, reach + 1) if o])


def index(docs: DataFrame) -> DataFrame:
    """Documents in blocks, each with a list of its words; stored, so that texts are split once.

    A document is a row (block, doc_id, places), where a place holds the number `at` of its word in the block; a word
    of a block is a row (block, at, word, n). Blocks are bounded, so the words of one fit a task at any size of corpus.
    """
    kinds = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("places", pa.binary()), ("at", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def rows(size: int, **found: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([found.get(k.name, pa.nulls(size, k.type)) for k in kinds], schema=kinds)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, n = TaskContext.get().partitionId() << 32, Index(), np.zeros(0, np.int64)

        def listed() -> pa.RecordBatch:
            at = pa.array(np.arange(len(words), dtype=np.int32))
            return rows(len(words), block=pa.array(np.full(len(words), block)), at=at, word=pa.array(list(words), pa.binary()), n=pa.array(n))

        for batch in batches:
            own = []
            for data in batch["data"].to_pylist():
                found = data.split()  # runs of anything but ASCII white space
                own.append(np.fromiter(map(words.__getitem__, found), "<u4", len(found)))
            more = np.bincount(np.concatenate(own), minlength=len(words))
            more[: len(n)] += n
            n = more
            places = pa.array([x.tobytes() for x in own], pa.binary())
            yield rows(len(own), block=pa.array(np.full(len(own), block)), doc_id=batch["doc_id"], places=places)
            if len(words) >= BLOCK_WORDS or n.sum() >= BLOCK_PLACES:
                yield listed()
                block, words, n = block + 1, Index(), np.zeros(0, np.int64)
        yield listed()

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    found = data.mapInArrow(number, "block long, doc_id long, places binary, at int, word binary, n long")
    return materialize(found, "llm-lm-blocks")


def look(s: Settings) -> Column:
    """Token of a word without a name: case and last two bytes."""
    word = F.col("word").cast("string")
    kind = F.when(word.rlike("[A-Z]") & ~word.rlike("[a-z]"), "U").when(word.rlike("^[A-Z]"), "T").when(word.rlike("^[a-z]"), "l").otherwise("o")
    return (1 + s.named + F.crc32(F.concat(kind.cast("binary"), F.expr("substring(word, -2, 2)"))) % s.looks).cast("int")


def vocabulary(docs: DataFrame, s: Settings = Settings()) -> tuple[Vocabulary, np.ndarray]:
    """(vocabulary, count of every token) over all documents."""
    known = _vocabulary(index(docs), s)
    return known, known.counts


def _vocabulary(indexed: DataFrame, s: Settings) -> Vocabulary:
    counted = store(indexed.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    named = [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(s.named).collect()]
    names = counted.sparkSession.createDataFrame([(w, i + 1) for i, w in enumerate(named)], "word binary, token int")
    words = counted.join(F.broadcast(names), "word", "left").select("word", "n", F.coalesce("token", look(s)).alias("token"))
    counts = np.zeros(s.size)
    for r in words.groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return Vocabulary(named, counts, words)


def tokenize(docs: DataFrame, known: Vocabulary, s: Settings = Settings()) -> DataFrame:
    """(doc_id, tokens, own) of every row: tokens as unsigned 16-bit numbers, and the log-probability of its words given these.

    A word's share in its token is its count among that token's; a word that the vocabulary has not seen counts as one
    more of its token.
    """
    return _tokenize(index(docs), known, s)


def _tokenize(indexed: DataFrame, known: Vocabulary, s: Settings) -> DataFrame:
    counts = known.counts

    def spell(rows: pa.Table, words: pa.Table) -> pa.Table:
        at, token, n = (words[c].to_numpy() for c in ("at", "token", "n"))
        tokens, shares = np.zeros(len(at), "<u2"), np.zeros(len(at))
        tokens[at] = token
        shares[at] = np.where(token > s.named, np.log(np.maximum(n, 1)) - np.log(counts[token] + 1), 0)
        own = [np.frombuffer(p, "<u4") for p in rows["places"].to_pylist()]
        found = {"tokens": pa.array([tokens[p].tobytes() for p in own], pa.binary()), "own": pa.array([shares[p].sum() for p in own], pa.float64())}
        return pa.table({"doc_id": rows["doc_id"], **found})

    words = indexed.filter("word IS NOT NULL").select("block", "at", "word").join(known.words, "word", "left")
    words = words.select(F.col("block").alias("of"), "at", F.coalesce("token", look(s)).alias("token"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = indexed.filter("places IS NOT NULL").select("block", "doc_id", "places")
    return rows.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(spell, "doc_id long, tokens binary, own double")


def train(tokens: DataFrame, counts: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Parameters of a network trained on all token rows."""
    flat = Network.start(s, counts)
    for k in range(max(s.rounds, s.turns)):
        flat = _round(tokens, tokens.sparkSession.sparkContext.broadcast(flat), k, s)
    return flat


def deal(s: Settings) -> np.ndarray:
    """Turns of successive places, at random; a text enters this list where its own checksum points, in every round alike."""
    return np.minimum(np.random.default_rng(s.seed).random(1 << 16) / s.masked, s.turns - 1).astype(np.int32)


def _round(tokens: DataFrame, start, k: int, s: Settings) -> np.ndarray:
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(s, start.value.copy())
        turns = deal(s)
        first, second, steps, places = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
        waiting = np.zeros((2 * s.reach + 1, 0), np.int32)

        def learn(examples: np.ndarray) -> None:
            nonlocal steps
            steps += 1
            grad = net.gradient(examples[:-1], examples[-1])
            first[:] = 0.9 * first + 0.1 * grad
            second[:] = 0.99 * second + 0.01 * grad * grad
            net.flat -= s.rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-6)

        for rows in batches:
            own = [np.frombuffer(t, "<u2").astype(np.int32) for t in rows["tokens"]]
            every, sizes = np.concatenate(own), np.array([len(t) for t in own])
            shifts = np.array([zlib.crc32(t) for t in rows["tokens"]]) - np.cumsum(sizes) + sizes
            chosen = np.flatnonzero(turns[(np.arange(len(every)) + np.repeat(shifts, sizes)) % len(turns)] == k % s.turns)
            waiting = np.c_[waiting, np.r_[contexts(own, s.reach, chosen), every[None, chosen]]]
            full = waiting.shape[1] // s.batch * s.batch
            for i in range(0, full, s.batch):
                learn(waiting[:, i : i + s.batch])
            waiting, places = waiting[:, full:], places + full
        if waiting.shape[1]:
            learn(waiting)
            places += waiting.shape[1]
        if places:
            yield pd.DataFrame({"places": [places], "flat": [net.flat]})

    trained = store(tokens.select("tokens").mapInPandas(fit, "places long, flat array<float>"), "lm-round")
    mean = trained.select("places", F.posexplode("flat").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("places")) / F.sum("places")).alias("v"))
    out = start.value.copy()
    for r in mean.collect():  # as many rows as the network has parameters
        out[r["i"]] = r["v"]
    return out


def score(tokens: DataFrame, flat: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """One row per row of `tokens`: doc_id, n_words, log_prob (natural, summed), mean_log_prob; every word counts.

    A word's probability is that of its token, given its neighbours, times its share in the token.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(flat)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(s, shared.value)
        for rows in batches:
            own = [np.frombuffer(t, "<u2").astype(np.int32) for t in rows["tokens"]]
            every, near = np.concatenate(own), contexts(own, s.reach)
            found = np.zeros(len(every) + 1)
            for a in range(0, len(every), 4096):
                found[a + 1 : a + 4097] = net.log_probs(near[:, a : a + 4096], every[a : a + 4096])
            ends = np.cumsum([len(t) for t in own])
            sums = np.cumsum(found)
            total = sums[ends] - sums[np.r_[0, ends[:-1]]]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_words": [len(t) for t in own], "log_prob": total + rows["own"]})

    rated = tokens.mapInPandas(rate, "doc_id long, n_words long, log_prob double")
    return rated.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def train_and_score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text) under a network trained on all of them.

    A null or empty text has no words, log_prob 0 and no mean; repeated rows get equal scores; an empty table gives no
    rows; extra columns are ignored.
    """
    indexed = index(texts(docs))
    known = _vocabulary(indexed, s)
    # Blocks are dealt unevenly; small row groups let Spark cut large files, so tasks that train and score are alike.
    tokens = materialize(_tokenize(indexed, known, s), "llm-lm-tokens", None, **{"parquet.block.size": str(4 << 20)})
    return score(tokens, train(tokens, known.counts, s), s)
