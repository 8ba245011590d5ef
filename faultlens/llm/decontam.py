"""Benchmark decontamination: passages of test items in documents, found by spaced seeds.

A fixed mask looks at some words of a window and ignores the others, so a hash of the seen words survives changes at
the ignored places. Documents and items that share a seed are aligned there; around the hit the aligned words score
one point for each equal and minus one for each different word, and the best stretch decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import ROW, join_small, row_id, store, text_hash, texts

#: 1: the word counts. Together they meet every stretch of MIN_SCORE points with up to three changed words, wherever
#: those stand (with four in 1806 of 1820 placings, with five in 8425 of 8568; longer stretches hold more windows).
MASKS = ("1111011", "1110100011", "10101111")
#: Points of a stretch that make a leak.
MIN_SCORE = 10
#: Items too short for that score leak as a whole: from this many words on inside of a document, below as all of it.
MIN_PASSAGE = 5


def plain_words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(text: str | Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.xxhash64(w)).alias("hashes")


def _seeds(rows: DataFrame, masks: tuple[str, ...], lengths: list[int]) -> DataFrame:
    """All columns but `hashes`, which becomes one row (at, seed) for each window of each mask.

    `lengths`: also all passages of so many words. A row below MIN_PASSAGE words gives itself as a whole.
    """
    rest = [c for c in rows.columns if c != "hashes"]
    size, at = F.size("hashes"), F.col("at")
    # Places first, their hashes after: outside of a function over an array, hashes are generated code. The explodes
    # are outer ones as a plain one makes Spark compute its array a second time to filter empty ones.
    rows = rows.select(*rest, "hashes", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("at"))
    seen = [(k, len(m), [j for j, c in enumerate(m) if c == "1"]) for k, m in enumerate(masks)]
    seen += [(-n, n, list(range(n))) for n in lengths]
    seeds = [F.when(at + span <= size, F.xxhash64(F.lit(k), *[F.get("hashes", at + j) for j in places])) for k, span, places in seen]
    whole = F.when((at == 0) & (size < MIN_PASSAGE), F.xxhash64(F.lit("whole"), "hashes"))
    return rows.select(*rest, "at", F.explode_outer(F.array(*seeds, whole)).alias("seed")).filter("seed IS NOT NULL")


def _best_stretch(doc: Column, item: Column, diagonal: Column) -> Column:
    """(best, matched, end) of the aligned words: the largest sum over neighbouring places, its equal words, its end."""
    first = F.greatest(F.lit(0), -diagonal)
    size = F.least(F.size(item), F.size(doc) - diagonal) - first
    pairs = F.zip_with(F.slice(doc, first + diagonal + 1, size), F.slice(item, first + 1, size), lambda a, b: a == b)
    zero = F.struct(*[F.lit(0).alias(n) for n in ("run", "equal", "best", "matched")])

    def step(s: Column, same: Column) -> Column:
        run = s["run"] + F.when(same, 1).otherwise(-1)
        run, equal = F.greatest(run, F.lit(0)), F.when(run > 0, s["equal"] + F.when(same, 1).otherwise(0)).otherwise(0)
        more = run > s["best"]
        return F.struct(
            run.alias("run"), equal.alias("equal"), F.greatest(run, s["best"]).alias("best"), F.when(more, equal).otherwise(s["matched"]).alias("matched")
        )

    return F.aggregate(pairs, zero, step)


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE) -> DataFrame:
    """(row_id, row_hash, doc_id, item_id, score, matched): the best stretch of every leak, one row for each pair.

    Null and empty texts give nothing. An item of fewer than `min_score` words leaks where all its words follow each
    other in a document; below MIN_PASSAGE words it must be the whole document. Rows that agree in id and text count
    once, items of one id are tried one by one and the best counts. An empty table on either side gives no rows,
    other columns stay behind.
    """
    rows = texts(docs).select("doc_id", row_id().alias("row_id"), text_hash().alias("row_hash"), "text")
    items = benchmark.select("item_id", plain_words(F.coalesce("text", F.lit(""))).alias("item")).distinct()
    items = store(items.select(F.xxhash64("item_id", "item").alias("item_key"), "item_id", "item"), "decontam-items")
    # At most min_score different lengths.
    short = items.select(F.size("item").alias("n")).filter(F.col("n").between(MIN_PASSAGE, min_score - 1)).distinct()
    lengths = sorted(r.n for r in short.collect())
    hashed = F.transform("item", lambda w: F.xxhash64(w)).alias("hashes")
    wanted = store(_seeds(items.select("item_key", hashed), masks, lengths).withColumnRenamed("at", "item_at"), "decontam-seeds")
    asked = store(wanted.select("seed").distinct(), "decontam-asked")
    hits = join_small(_seeds(rows.select(*ROW, _hashes("text")), masks, lengths), asked, ["seed"], "left_semi", 24)
    hits = store(hits.distinct(), "decontam-hits")
    # Plain rows throughout: a seed of many items and a document of many hits are joins that Spark may split.
    placed = join_small(hits, wanted, ["seed"], "inner", 40)
    placed = store(placed.select(*ROW, "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "decontam-placed")
    met = store(placed.select(*ROW).distinct(), "decontam-met")
    met = store(join_small(rows, met, ROW, "left_semi", 40).select("doc_id", *ROW, plain_words("text").alias("words")), "decontam-words")
    found = join_small(met, placed, ROW, "inner", 48)
    found = join_small(found, items, ["item_key"], "inner", 512)
    best = _best_stretch(F.col("words"), F.col("item"), F.col("diagonal")).alias("s")
    found = found.select("doc_id", *ROW, "item_id", F.least(F.lit(min_score), F.size("item")).alias("needed"), best)
    found = found.filter(F.col("s.best") >= F.col("needed"))
    return found.groupBy(*ROW, "doc_id", "item_id").agg(F.max(F.struct("s.best", "s.matched")).alias("s")).select(
        *ROW, "doc_id", "item_id", F.col("s.best").cast("long").alias("score"), F.col("s.matched").cast("long").alias("matched")
    )


def clean(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no leak; all rows where the benchmark is empty."""
    found = store(leaks(docs, benchmark, masks, min_score).select(*ROW).distinct(), "decontam-rows")
    keyed = docs.withColumns({"__row_id": row_id(), "__row_hash": text_hash()})
    found = found.withColumnsRenamed({"row_id": "__row_id", "row_hash": "__row_hash"})
    return join_small(keyed, found, ["__row_id", "__row_hash"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
