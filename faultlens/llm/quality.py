"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms, one of character classes and one of common words, are compared with the histograms of the
document's language by Jensen-Shannon distance (base 2, between 0 and 1). Every document that passes the base rules
is judged by its histograms; a caller may spare short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store, text_hash, texts, words

# Common words of the four languages.
COMMON_WORDS = (
    "the of and to in a is that "
    "der die und zu den das von mit "
    "de la le et les des en un "
    "que el y los se del por con"
).split()
SYMBOLS = "[^#*$%&|<>]+"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
#: Lower bounds that reject only when both are passed.
BOTH_CLASS_DISTANCE = 0.14
BOTH_WORD_DISTANCE = 0.24


def _rest(text: Column, pattern: str) -> Column:
    """Characters left when the runs that match a pattern are cut out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common.

    `classes` counts upper case, lower case, digits, spaces, symbols and the rest; `common` counts COMMON_WORDS
    and, last, all other words. A null or empty text counts 0 everywhere. All of it stays within the row.
    """
    text = F.col("text")
    keep = ("text_hash", *keep)
    rows = texts(docs, *keep[1:]).select("doc_id", text_hash().alias("text_hash"), *keep[1:], "text", words("text").alias("words"))
    rows = rows.select(
        "doc_id",
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(text).cast("long").alias("chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _rest(text, SYMBOLS).alias("n_symbols"),
        _rest(text, r"\P{Lu}+").alias("upper"),
        _rest(text, r"\P{Ll}+").alias("lower"),
        _rest(text, r"\P{N}+").alias("digit"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter("words", lambda w: w.isin(COMMON_WORDS)).alias("known"),
        # (hash, place) of every three-word window
        F.when(
            F.size("words") > 2,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
                ),
            ),
        ).alias("windows"),
    )
    rows = rows.withColumn("windows", F.sort_array("windows"))
    same = lambda x, j: (x["h"] == F.get("windows", j - 1)["h"]) | (x["h"] == F.get("windows", j + 1)["h"])
    rows = rows.withColumn(
        "again", F.sort_array(F.transform(F.filter("windows", same), lambda x: x["i"]))
    )
    covered = F.transform("again", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - at, F.lit(3))))
    space = F.col("chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("upper") - F.col("lower") - F.col("digit") - F.col("n_symbols")
    counts = [F.size(F.array_remove("known", c)) for c in COMMON_WORDS]
    counts = [(F.size("known") - n).cast("long") for n in counts]
    return rows.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array("upper", "lower", "digit", space, "n_symbols", F.greatest(other, F.lit(0))).alias("classes"),
        F.array(*counts, F.col("n_words") - F.size("known")).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """Histograms of every language: sums over all its documents that pass the base rules.

    A document of no stated language is held against documents of no stated language.
    """
    n_classes, n_common = 6, len(COMMON_WORDS) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    return (
        measured.filter(~base_failed())
        .groupBy("lang")
        .agg(*sums)
        .select(
            F.col("lang").alias("ref_lang"),
            F.array(*[f"c{i}" for i in range(n_classes)]).alias("ref_classes"),
            F.array(*[f"w{i}" for i in range(n_common)]).alias("ref_common"),
        )
    )


def total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def js_distance(a: str, b: str, p_sum: Column, q_sum: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts with their sums; null if either has no count."""

    def term(x: Column, y: Column) -> Column:
        p, q = x / p_sum, y / q_sum
        part = lambda v: F.when(v > 0, v * F.log2(2 * v / (p + q))).otherwise(F.lit(0.0))
        return part(p) + part(q)

    value = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((p_sum > 0) & (q_sum > 0), F.sqrt(F.greatest(value, F.lit(0.0))))


def judge(
    docs: DataFrame,
    reference: DataFrame | None = None,
    guard_words: int = 0,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    both: tuple[float, float] = (BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE),
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): the measures, base_failed, both distances and `kept`.

    `reference` (ref_lang, ref_classes, ref_common) defaults to the histograms of the documents themselves, all
    of them. A language without a reference gives null distances and leaves the verdict to the base rules.
    Documents of fewer than `guard_words` words are judged by the base rules alone; by default none are spared.
    Repeated rows are judged one by one, an empty table gives no rows, extra columns are ignored.
    """
    measured = store(measures(docs, "lang"), "quality")
    reference = references(measured) if reference is None else reference
    reference = store(reference, "quality-reference")
    joined = measured.join(reference, measured.lang.eqNullSafe(reference.ref_lang), "left")
    # Sums as columns of their own: inside of the distance they would be taken again for every bin.
    names = ("classes", "ref_classes", "common", "ref_common")
    joined = joined.withColumns({f"sum_{c}": total(c) for c in names})
    sums = {c: F.col(f"sum_{c}") for c in names}
    joined = joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        js_distance("classes", "ref_classes", sums["classes"], sums["ref_classes"]).alias("class_distance"),
        js_distance("common", "ref_common", sums["common"], sums["ref_common"]).alias("word_distance"),
    )
    by_class, by_word = (F.coalesce(c, F.lit(0.0)) for c in ("class_distance", "word_distance"))
    far = (by_class > max_class_distance) | (by_word > max_word_distance) | ((by_class > both[0]) & (by_word > both[1]))
    return joined.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= guard_words) & far))
