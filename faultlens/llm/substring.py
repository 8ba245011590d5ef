"""Substring dedup: words that lie in a window of fixed length which an earlier document holds as well.

Every window of `window` words has a Rabin-Karp hash; windows are counted in Spark by runs that share an anchor
(anchors.py), windows of differing runs one by one under a 128-bit hash. Overlapping repeats merge into maximal
intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import anchors
from faultlens.llm.common import store, texts

WINDOW = 50
GRAM = 10
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 18


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str) -> list[bytes]:
    """Words: runs of anything but ASCII white space, which is what bytes.split() cuts at."""
    return text.encode("utf-8", "surrogatepass").split()


def word_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, anchor, content, first, n) of all runs of windows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                out += [(int(doc_id), *run[:4]) for run in anchors.runs(known.of(split(text)), window, gram)]
            yield anchors.stacked(["doc_id", "anchor", "content", "first", "n"], out)

    return docs.mapInPandas(scan, "doc_id long, anchor long, content long, first long, n long")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): maximal intervals [(first, end)] of words to remove, for documents that have any.

    A window goes if its words also start in a document of a smaller id. Rows without an id take no part; rows of the
    same id count as one document, so they do not remove each other's words.
    """
    docs = texts(docs).filter("doc_id IS NOT NULL")
    runs = store(word_runs(docs, window, gram), "substring-runs")
    # An anchor of one document marks windows that no other has.
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    runs = store(runs.join(store(shared, "substring-anchors"), "anchor", "left_semi"), "substring-shared")
    contents = store(
        runs.groupBy("anchor", "content", "n").agg(F.min(F.struct("doc_id", "first")).alias("least")), "substring-contents"
    )
    runs = runs.join(contents, ["anchor", "content", "n"]).select("doc_id", "anchor", "content", "first", "n", F.col("least.doc_id").alias("lo"))
    whole = runs.filter("doc_id > lo").select("doc_id", "first", (F.col("first") + F.col("n") + window - 1).alias("end"))

    # Runs of one anchor that differ: their windows are counted one by one, each content once.
    mixed = contents.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor")
    mixed = store(mixed, "substring-mixed")
    asked = contents.join(mixed, "anchor", "left_semi").select(
        F.col("least.doc_id").alias("doc_id"), F.struct("anchor", "content", "n", F.col("least.first").alias("first")).alias("run")
    )
    asked = store(asked, "substring-asked").groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    windows = store(docs.join(asked, "doc_id").mapInPandas(_windows(window), WINDOW_ROWS), "substring-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    least = store(least.drop("hi"), "substring-least")
    # Written before they are grouped, so that Spark may split the join where many documents share a window.
    late = store(windows.join(least, ["h1", "h2"]).filter("doc_id > lo").drop("h1", "h2", "lo"), "substring-late")
    late = late.groupBy("anchor", "content", "n", "doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    part = runs.filter("doc_id = lo").join(late, ["anchor", "content", "n", "doc_id"])
    part = part.select("doc_id", F.explode(_stretches("places", window)).alias("s"), "first").select(
        "doc_id", (F.col("first") + F.col("s.first")).alias("first"), (F.col("first") + F.col("s.end")).alias("end")
    )
    return merge(whole.unionByName(part))


WINDOW_ROWS = "h1 long, h2 long, anchor long, content long, n long, doc_id long, place long"


def _windows(window: int):
    """Rows of a document and its runs -> a row for each window of these runs."""

    names = ["h1", "h2", "anchor", "content", "n", "doc_id", "place"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for rows in batches:
            out = []
            # Repeated rows of an id may differ in text: a run belongs where its content says.
            for doc_id, text, asked in zip(rows["doc_id"], rows["text"], rows["runs"], strict=True):
                values = known.of(split(text))
                for run in asked:
                    part = values[run["first"] : run["first"] + run["n"] + window - 1]
                    if len(part) < window:
                        continue
                    one, two = (anchors.Rolling(part, b) for b in anchors.BASES)
                    if int(one.of(np.array([0]), np.array([len(part)])).view(np.int64)[0]) != run["content"]:
                        continue
                    h1, h2 = one.every(window).view(np.int64), two.every(window).view(np.int64)
                    out.append((h1, h2, run["anchor"], run["content"], run["n"], doc_id, np.arange(len(h1))))
                    if len(out) > 2000:
                        yield anchors.stacked(names, out)
                        out = []
            yield anchors.stacked(names, out)

    return scan


def _stretches(places: str, window: int):
    """Sorted window places -> [(first, end)] of the words they cover, neighbours united."""
    joins = lambda x, i: F.coalesce(x <= F.get(places, i - 1) + window, F.lit(False))
    starts = F.filter(places, lambda x, i: ~joins(x, i))
    ends = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + 1) > x + window, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b + window).alias("end")))


def merge(spans: DataFrame) -> DataFrame:
    """(doc_id, first, end) -> one row per document with its maximal intervals, touching ones united."""
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "spans": [united(s) for s in rows["spans"]]})

    return listed.mapInPandas(unite, "doc_id long, spans array<struct<first:long,end:long>>")


def united(spans) -> list[dict]:
    out: list[dict] = []
    for s in spans:
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"first": s["first"], "end": s["end"]})
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, removed (intervals of words), kept (text).

    `kept` is the kept words joined by one space. A null or empty text has no words; rows without an id keep all
    theirs; an empty table gives no rows; extra columns are ignored. Repeated rows of an id share its intervals.
    """
    found = repeats(docs, window, gram)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc_id, text, spans in zip(rows["doc_id"], rows["text"], rows["spans"], strict=True):
                words = split(text)
                removed = [] if spans is None else [{"first": s["first"], "end": min(s["end"], len(words))} for s in spans if s["first"] < len(words)]
                kept, at = [], 0
                for s in removed:
                    kept += words[at : s["first"]]
                    at = s["end"]
                kept += words[at:]
                out.append((None if pd.isna(doc_id) else int(doc_id), len(words), len(words) - len(kept), removed, b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed", "kept"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept string"
    return texts(docs).join(found, "doc_id", "left").mapInPandas(cut, schema)
