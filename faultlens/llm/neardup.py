"""MinHash near-dedup: weighted Jaccard over TF-IDF shingles by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: how often a shingle stands in it times the mean inverse
document frequency of its words. Each sample draws one (shingle, level) so that two documents draw the same with the
probability of their weighted Jaccard similarity; rows of samples form bands, and documents that share a band are
candidates, verified by the similarity itself.

Equal texts are one node. Every node of a bucket is held against the bucket's least node, which settles the buckets
of real copies; in buckets that still hold several components, members of different components are compared block by
block, so no link is lost and no pair is emitted that is not one. The links' components are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import anchors
from faultlens.llm.common import ROW, attach, join_small, row_id, store, text_hash, texts
from faultlens.llm.substring import WordHashes, split


class Settings(NamedTuple):
    words: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 4
    #: Document frequencies are counted by this many buckets of words: what is broadcast has a fixed size.
    buckets: int = 1 << 18
    #: Members and bytes of text of a block that is compared with another.
    block_members: int = 128
    block_bytes: int = 1 << 20


# Draws of the samples: triples (r, ln c, beta) that a shingle picks by its hash, another one for every sample.
_DRAWS = 1 << 16


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.gamma(2, 1, _DRAWS), np.log(rng.gamma(2, 1, _DRAWS)), rng.random(_DRAWS)


def _multipliers(n: int) -> np.ndarray:
    return anchors.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(anchors.BASES[0])) | np.uint64(1)


def shingles(values: np.ndarray, idf: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the distinct shingles of a sequence of word hashes."""
    if len(values) < words:
        return np.zeros(0, np.uint64), np.zeros(0)
    hashes, at, times = np.unique(anchors.Rolling(values).every(words), return_index=True, return_counts=True)
    sums = np.r_[0.0, np.cumsum(idf[values % np.uint64(len(idf))])]
    return hashes, times * np.round((sums[at + words] - sums[at]) / words, 6)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int, draws) -> np.ndarray:
    """Band keys of non-empty weighted sets, one line each."""
    r, ln_c, beta = draws
    sizes = np.array([len(h) for h, _ in sets])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    h, ln_w = np.concatenate([h for h, _ in sets]), np.log(np.concatenate([w for _, w in sets]))
    out = np.empty((len(sets), bands * rows), np.uint64)
    for k, m in enumerate(_multipliers(bands * rows)):
        pick = ((h * m) >> np.uint64(48)).astype(np.int64)
        step, shift = r[pick], beta[pick]
        level = np.floor(ln_w / step + shift)
        ln_a = ln_c[pick] - step * (level - shift + 1)
        least = np.minimum.reduceat(ln_a, begin)
        hit = np.flatnonzero(ln_a == np.repeat(least, sizes))
        # Hashes are sorted, so of equal values the least hash is the first.
        first = hit[np.searchsorted(hit, begin)]
        out[:, k] = anchors.mix(h[first] ^ anchors.mix(level[first].astype(np.int64).view(np.uint64)))
    keys = np.zeros((len(sets), bands), np.uint64)
    for row in range(rows):
        keys = anchors.mix(keys * np.uint64(anchors.BASES[1]) + out[:, row::rows][:, :bands])
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima by sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) and len(b[0]) else 0.0


def word_idf(docs: DataFrame, buckets: int) -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)) for every bucket of words, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, df, n = WordHashes(), np.zeros(buckets, np.int64), 0
        for rows in batches:
            for text in rows["text"]:
                n += 1
                df[np.unique(known.of(split(text)) % np.uint64(buckets)).astype(np.int64)] += 1
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.r_[-1, seen], "n": np.r_[n, df[seen]]})

    counted = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = store(counted, "near-idf").toPandas()  # at most `buckets` + 1 rows
    df = np.zeros(buckets + 1, np.int64)
    df[counted["bucket"].to_numpy()] = counted["n"].to_numpy()  # -1: all documents, kept last
    return 1 + np.log((1 + df[-1]) / (1 + df[:-1]))


def _sign(idf, s: Settings):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, draws = WordHashes(), _draws()
        for rows in batches:
            values = [known.of(split(t)) for t in rows["text"]]
            digests = [np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64) for v in values]
            sets = [shingles(v, idf.value, s.words) for v in values]
            full = [i for i, x in enumerate(sets) if len(x[0])]
            bands: list = [None] * len(sets)
            # A few hundred thousand shingles at a time.
            chunk, held = [], 0
            for i in [*full, None]:
                if chunk and (i is None or held > 200_000):
                    for j, keys in zip(chunk, signatures([sets[j] for j in chunk], s.bands, s.rows, draws), strict=True):
                        bands[j] = keys.view(np.int64)
                    chunk, held = [], 0
                if i is not None:
                    chunk.append(i)
                    held += len(sets[i][0])
            yield pd.DataFrame(
                {
                    "row_id": rows["row_id"],
                    "row_hash": rows["row_hash"],
                    "node": [d[0] for d in digests],
                    "check": [d[1] for d in digests],
                    "size": [len(t) for t in rows["text"]],
                    "bands": bands,
                }
            )

    return scan


SIGNED = "row_id long, row_hash long, node long, check long, size long, bands array<long>"


def _verify(idf, s: Settings):
    """Rows of two nodes and their texts -> the pairs that are similar."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, lead = WordHashes(), None, None
        for rows in batches:
            out = []
            for a, b, text_a, text_b in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                if a != last:
                    last, lead = a, shingles(known.of(split(text_a)), idf.value, s.words)
                if similarity(lead, shingles(known.of(split(text_b)), idf.value, s.words)) >= s.similarity:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return scan


def _least_sums(sets: list[tuple[np.ndarray, np.ndarray]], width: int = 1 << 13) -> np.ndarray:
    """Sum of minima of the weights of every two sets: [i, j].

    With the weights of a shingle in rising order w1 <= w2 ..., min(x, y) is the sum of the steps w1, w2 - w1, ... that
    both x and y reach. So each step is a column of zeros and ones, and all sums are one product of matrices, made of
    some thousand columns at a time.
    """
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    h, w = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    order = np.lexsort((w, h))
    h, w, owner = h[order], w[order], owner[order]
    new = np.r_[True, h[1:] != h[:-1]]
    step = new | np.r_[True, w[1:] != w[:-1]]
    column = np.cumsum(step) - 1  # the last step that a row reaches
    height = w[step] - np.where(new[step], 0.0, np.r_[0.0, w[step][:-1]])
    first = np.maximum.accumulate(np.where(new, column, 0))  # the first step of its shingle
    # A row reaches all steps of its shingle up to its own.
    n = column - first + 1
    rows = np.repeat(owner, n)
    cols = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    shared = np.bincount(cols, minlength=len(height)) > 1
    keep = shared[cols]
    rows, cols, height = rows[keep], (np.cumsum(shared) - 1)[cols[keep]], height[shared]
    by = np.argsort(cols, kind="stable")
    rows, cols = rows[by], cols[by]
    out = np.zeros((len(sets), len(sets)))
    for begin in range(0, len(height), width):
        lo, hi = np.searchsorted(cols, (begin, begin + width))
        block = np.zeros((len(sets), min(width, len(height) - begin)))
        block[rows[lo:hi], cols[lo:hi] - begin] = 1.0
        out += (block * height[begin : begin + width]) @ block.T
    return out


def _compare(idf, s: Settings):
    """Members of two blocks of a bucket -> links between different components, enough to connect them."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        known = WordHashes()
        sets = [shingles(known.of(split(t)), idf.value, s.words) for t in rows["text"]]
        least = _least_sums(sets)
        total = np.array([x.sum() for _, x in sets])
        near = least >= s.similarity * (total[:, None] + total[None, :] - least)
        label, node, out = rows["label"].to_numpy().copy(), rows["node"].to_numpy(), []
        for i, j in np.argwhere(np.triu(near, 1)):
            if label[i] != label[j]:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return link


def thinned(links: DataFrame) -> DataFrame:
    """Links (lead, node) -> fewer of them that connect the same nodes.

    A node has a lead of each band at most. It keeps the least of them, which its other leads are linked to instead;
    copies share their leads, so these links are few.
    """
    each = links.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("leads"))
    least = F.least("b", F.element_at("leads", 1))
    linked = F.array_union("leads", F.array("b"))
    return each.select(least.alias("a"), F.explode(linked).alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for all nodes of (a, b) edges."""
    edges = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = store(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        seen = edges.join(of, "b").groupBy("a").agg(F.min("other").alias("other")).withColumnRenamed("a", "node")
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        # Jump: the label of the label, known from the round before.
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = store(step, "near-labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(row_id, row_hash, class_id, class_size, kept) for every distinct row of `docs`.

    `class_id` is the least id of the class, null where no member has one; `kept` marks the earliest row, by id and
    then by the hash of the text. A text of fewer than five words is near only to texts of the same words.
    """
    spark = docs.sparkSession
    rows = texts(docs).select("doc_id", row_id().alias("row_id"), text_hash().alias("row_hash"), "text")
    idf = spark.sparkContext.broadcast(word_idf(rows, s.buckets))
    signed = store(rows.select(*ROW, "text").mapInPandas(_sign(idf, s), SIGNED), "near-signed")
    nodes = signed.groupBy("node", "check").agg(
        F.min(F.struct(*ROW)).alias("row"), F.min("size").alias("size"), F.any_value("bands").alias("bands")
    )
    members = store(nodes.select("node", "row", "size", F.posexplode("bands").alias("band", "key")), "near-members")
    buckets = members.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("node").alias("lead"), F.sum("size").alias("bytes")
    )
    buckets = store(buckets.filter("n > 1"), "near-buckets")
    members = store(members.join(buckets, ["band", "key"]), "near-candidates")
    asked = store(members.select("node", F.col("row.row_id"), F.col("row.row_hash")).distinct(), "near-nodes")
    known = store(join_small(rows.select(*ROW, "text"), asked, ROW, "inner").select("node", "text").dropDuplicates(["node"]), "near-texts")

    pairs = members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = store(pairs.select("a", "b", "text_a", "text_b").mapInPandas(_verify(idf, s), "a long, b long"), "near-links")
    labels = components(thinned(links))

    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = store(labelled.groupBy("band", "key", "label").agg(F.count("*").alias("m")), "near-mixed")
    mixed = by_label.groupBy("band", "key").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most"))
    mixed = mixed.filter("labels > 1").select("band", "key", F.col("most.label").alias("most"))
    # The lead has met all; the largest component needs no look at itself, only at the members outside of it.
    open_ = labelled.join(mixed, ["band", "key"]).filter("node <> lead")
    blocks = F.greatest(F.ceil(F.col("n") / s.block_members), F.ceil(F.col("bytes") / s.block_bytes)).cast("int")
    open_ = open_.select("band", "key", "node", "label", blocks.alias("blocks"), (F.col("label") == F.col("most")).alias("inner"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Outsiders of block i stand in cells (i, j) for all j; all members of block j stand in cells (i, j) for all i.
    outside = open_.filter("NOT inner").select("*", F.col("block").alias("i"), other.alias("j"))
    every = open_.select("*", other.alias("i"), F.col("block").alias("j"))
    cells = outside.unionByName(every).select("band", "key", "i", "j", "node", "label").distinct()
    cells = cells.join(known, "node")
    more = cells.groupBy("band", "key", "i", "j").applyInPandas(_compare(idf, s), "a long, b long")
    stars = labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
    labels = components(stars.unionByName(store(more, "near-more")))

    placed = signed.select(*ROW, "node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = store(placed, "near-placed")
    least = F.min(F.when(F.col("row_id") > -(1 << 63), F.col("row_id")))
    summed = placed.groupBy("label").agg(least.alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(*ROW)).alias("first"))
    summed = store(summed, "near-summed")
    return store(
        placed.join(summed, "label").select(*ROW, F.struct("class_id", "class_size", (F.struct(*ROW) == F.col("first")).alias("kept")).alias("near")),
        "near-classes",
    )


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` with all its columns and __class_id, __class_size, __kept.

    A null text is the empty one, and empty texts are copies of each other; rows that agree in id and text are one
    document and share its verdict; an empty table gives no rows.
    """
    found = attach(docs, classes(docs, s), "near", 48)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__payload.{c}").alias(f"__{c}") for c in ("class_id", "class_size", "kept")])
