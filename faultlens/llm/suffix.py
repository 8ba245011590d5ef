"""Suffix-array dedup: bytes that lie in a string of fixed length which stands anywhere else, too.

Strings of `length` bytes meet through the anchors of anchors.py. Where runs of one anchor differ, their bytes go to
a block of bounded size; its Burrows-Wheeler transform is searched breadth-first by backward extension, which yields
the common prefixes of neighbouring suffixes by increasing value and stops at `length`: boundaries that are still
open then separate nothing, so suffixes between two set boundaries start with the same `length` bytes. Anchors whose
runs fill several blocks are settled by a count of the blocks' strings in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import anchors
from faultlens.llm.common import ROW, row_id, store, text_hash, texts
from faultlens.llm.substring import united

LENGTH = 400
GRAM = 32
#: Most bytes of an anchor's runs that one transform holds; small anchors share one of a quarter of that.
BLOCK_BYTES = 4 << 20

RUN = ["anchor", "content", "n"]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols (0 ... 256), by prefix doubling."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64), np.zeros(7, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    done = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]], dtype=np.int32)
        if done >= depth or rank[order[-1]] == n:
            return order.astype(np.int32)
        key = rank.astype(np.int64) * (n + 1)
        key[:-done] += rank[done:]
        done *= 2


def common_prefix_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes in order and, for each, which of them agree in their first `length` symbols.

    Symbol 0 separates strings and ends the last one; classes of suffixes that reach a separator sooner mean nothing.
    """
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1].astype(np.int16)
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    to = np.empty(n, np.int32)  # where a suffix goes when it is extended to the left
    to[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following, previous = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]

    boundary = np.zeros(n + 1, bool)
    boundary[[0, n]] = True
    begin, end = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):  # common prefixes of 0, 1, ... symbols
        if not len(begin):
            break
        size = end - begin
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]].astype(np.int32), size)
        text = bwt[at] > 0
        last = at[text & (following[at] >= np.repeat(end, size))]
        first = at[text & (previous[at] < np.repeat(begin, size))]
        # Extensions of disjoint intervals are disjoint, so sorted begins and ends belong together.
        begin, end = np.sort(to[first]), np.sort(to[last]) + 1
        new = ~boundary[end]
        begin, end = begin[new], end[new]
        boundary[end] = True
    return order, np.cumsum(boundary[:n]) - 1


def byte_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row_id, row_hash, anchor, content, first, n, again) of all runs of strings of `length` bytes."""

    names = ["row_id", "row_hash", "anchor", "content", "first", "n", "again"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, held = [], 0
            for row_id, row_hash, text in zip(rows["row_id"], rows["row_hash"], rows["text"], strict=True):
                values = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for begin in range(0, max(len(values) - length + 1, 0), anchors.STRETCH):
                    part = values[begin : begin + anchors.STRETCH + length - 1].astype(np.uint64)
                    for anchor, content, first, n, again in anchors.runs(part, length, gram, places=True):
                        out.append((row_id, row_hash, anchor, content, first + begin, n, again))
                        held += len(n)
                    if held > 20_000:
                        yield anchors.stacked(names, out)
                        out, held = [], 0
            yield anchors.stacked(names, out).astype({"again": bool})

    return docs.mapInPandas(scan, "row_id long, row_hash long, anchor long, content long, first long, n long, again boolean")


def _cut(length: int):
    """Rows of a document and its runs -> the bytes of each run."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, held = [], 0
            for text, asked in zip(rows["text"], rows["runs"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in asked:
                    part = data[r["first"] : r["first"] + r["n"] + length - 1]
                    out.append((r["anchor"], r["content"], r["n"], r["weight"], r["block"], r["blocks"], part))
                    held += len(part)
                    if held > 4 << 20:
                        yield pd.DataFrame(out, columns=CUT)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=CUT)

    return scan


CUT = ["anchor", "content", "n", "weight", "block", "blocks", "bytes"]
CUT_ROWS = "anchor long, content long, n long, weight long, block long, blocks long, bytes binary"
FOUND = ["anchor", "content", "n", "places", "h1", "h2", "weight"]
FOUND_ROWS = "anchor long, content long, n long, places array<struct<first:long,end:long>>, h1 long, h2 long, weight long"


def _stretches(flags: np.ndarray, length: int) -> list[dict]:
    """Marked string starts -> [(first, end)] of the bytes they cover, neighbours united."""
    at = np.flatnonzero(flags)
    gap = np.flatnonzero(np.diff(at) > length)
    firsts, lasts = at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]]
    return [{"first": int(a), "end": int(b) + length} for a, b in zip(firsts, lasts, strict=True)]


def _search(runs: list[tuple], length: int) -> list[tuple]:
    """The strings of a block that it holds twice, as places of runs; of shared anchors also what other blocks need."""
    sizes = np.array([len(r[-1]) + 1 for r in runs])
    ends = np.cumsum(sizes)
    symbols = np.zeros(ends[-1], np.int16)
    owner = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)
    for r, end, size in zip(runs, ends, sizes, strict=True):
        symbols[end - size : end - 1] = np.frombuffer(r[-1], np.uint8).astype(np.int16) + 1
    starts = (np.arange(len(symbols)) - (ends - sizes)[owner]).astype(np.int32)
    n = np.array([r[2] for r in runs])
    order, classes = common_prefix_classes(symbols, length)
    valid = starts[order] < n[owner[order]]
    order, classes = order[valid], classes[valid]
    weight = np.array([r[3] for r in runs])[owner[order]]
    total = np.bincount(classes, weights=weight)[classes].astype(np.int64)
    twice = np.zeros(len(symbols), bool)
    twice[order[total > 1]] = True
    split = np.array([r[5] > 1 for r in runs])
    out = []
    for r, end, size in zip(runs, ends, sizes, strict=True):
        own = twice[end - size : end - size + r[2]]
        if own.any():
            out.append((r[0], r[1], r[2], _stretches(own, length), None, None, None))
    if split.any():
        # One row for each string that is single here, and one for each class that is not.
        leader = np.r_[True, classes[1:] != classes[:-1]]
        asked = np.flatnonzero(split[owner[order]] & ((total == 1) | leader))
        hashes = [anchors.Rolling(symbols.astype(np.uint64), b).of(order[asked], order[asked] + length).view(np.int64) for b in anchors.BASES]
        for i, h1, h2 in zip(asked.tolist(), *(h.tolist() for h in hashes), strict=True):
            r, at = runs[owner[order[i]]], int(starts[order[i]])
            places = [{"first": at, "end": at + length}] if total[i] == 1 else []
            out.append((r[0], r[1], r[2], places, h1, h2, int(total[i])))
    return out


def _blocks(length: int, block_bytes: int):
    """Runs in the order of their blocks -> what the searches of whole blocks find; small blocks share a search."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held, last = [], 0, None
        for rows in batches:
            for r in rows[CUT].itertuples(index=False, name=None):
                if waiting and r[:3] == waiting[-1][:3]:
                    continue
                if 4 * held >= block_bytes and (r[0], r[4]) != last:
                    yield pd.DataFrame(_search(waiting, length), columns=FOUND).astype({"h1": "Int64", "h2": "Int64", "weight": "Int64"})
                    waiting, held = [], 0
                waiting.append(r)
                held, last = held + len(r[-1]), (r[0], r[4])
        if waiting:
            yield pd.DataFrame(_search(waiting, length), columns=FOUND).astype({"h1": "Int64", "h2": "Int64", "weight": "Int64"})

    return scan


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, row_hash, first, end): bytes of strings that stand at two places or more, by row of `_rows(docs)`."""
    runs = store(byte_runs(docs, length, gram), "suffix-runs")
    shared = runs.groupBy("anchor").agg(F.count("*").alias("m"), F.max("again").alias("again")).filter("m > 1 OR again")
    runs = store(runs.join(store(shared.select("anchor"), "suffix-anchors"), "anchor", "left_semi"), "suffix-shared")
    contents = runs.groupBy(*RUN).agg(F.count("*").alias("weight"), F.max("again").alias("again"), F.min(F.struct(*ROW, "first")).alias("at"))
    contents = store(contents, "suffix-contents")
    runs = runs.join(contents.select(*RUN, "weight"), RUN)
    whole = runs.filter("weight > 1").select(*ROW, "first", (F.col("first") + F.col("n") + length - 1).alias("end"))

    # Runs of one anchor that differ, or that may repeat a string of their own, each content once.
    mixed = contents.groupBy("anchor").agg(
        F.count("*").alias("m"), F.max("again").alias("again"), F.sum(F.col("n") + length).alias("bytes")
    )
    mixed = store(mixed.filter("m > 1 OR again").select("anchor", F.ceil(F.col("bytes") / block_bytes).alias("blocks")), "suffix-mixed")
    asked = contents.join(mixed, "anchor").select(
        "at.row_id",
        "at.row_hash",
        F.struct(*RUN, "weight", "at.first", "blocks", F.pmod(F.xxhash64("content"), F.col("blocks")).alias("block")).alias("run"),
    )
    asked = store(asked, "suffix-asked").groupBy(*ROW).agg(F.collect_list("run").alias("runs"))
    # Equal rows cut the same run twice; the sort brings both together and the search takes one.
    parts = docs.join(asked, ROW).mapInPandas(_cut(length), CUT_ROWS)
    found = parts.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "content", "n").mapInPandas(_blocks(length, block_bytes), FOUND_ROWS)
    found = store(found, "suffix-found")
    across = found.filter("h1 IS NOT NULL")
    twice = across.groupBy("h1", "h2").agg(F.sum("weight").alias("total")).filter("total > 1").select("h1", "h2")
    twice = store(twice, "suffix-twice")
    across = across.join(twice, ["h1", "h2"], "left_semi").filter(F.size("places") > 0)
    found = found.filter("h1 IS NULL").select(*RUN, "places").unionByName(across.select(*RUN, "places"))
    part = runs.filter("weight = 1").join(found, RUN).select(*ROW, "first", F.explode("places").alias("p"))
    part = part.select(*ROW, (F.col("first") + F.col("p.first")).alias("first"), (F.col("first") + F.col("p.end")).alias("end"))
    return whole.unionByName(part)


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", row_id().alias("row_id"), text_hash().alias("row_hash"), "text")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, removed (maximal runs of bytes), kept (bytes).

    Every row counts as a text of its own, repeated rows and rows without an id as well, so both of two equal rows
    lose what they share. A null or empty text has no bytes; an empty table gives no rows; extra columns are ignored.
    """
    rows = _rows(docs)
    spans = repeats(rows, length, gram, block_bytes)
    spans = spans.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                removed = [] if spans is None else united(spans)
                for s in removed:
                    kept.append(data[at : s["first"]])
                    at = s["end"]
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((None if pd.isna(doc_id) else int(doc_id), len(data), len(data) - len(rest), removed, rest))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "removed", "kept"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<first:long,end:long>>, kept binary"
    return rows.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInPandas(cut, schema)
