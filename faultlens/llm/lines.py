"""Line dedup: lines that an earlier line equals but for at most one word.

Equal lines meet by their hash. For the rest, each distinct line emits the hashed deletion-neighbourhood of its words:
the line without word i, for every i, and the line itself at every place where a longer line may hold one word more.
Variants carry the place of the deletion, so lines that share one are within one edit of each other and each needs to
meet only the earliest of them. Before that, a line whose two halves occur in no other line is out: a single edit
leaves one half as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import ROW, attach, join_small, row_id, store, text_hash, texts, words

#: Lines below this many words are kept whatever repeats: blank lines only.
MIN_WORDS = 1
#: Lines below this many words must be equal; in longer ones one word may differ, whatever their length.
MIN_WORDS_NEAR = 10

LINE = ["h1", "h2"]
PLACE = ["row_id", "row_hash", "line_no"]


def _halves(w: Column) -> Column:
    """(side, length, hash) of the beginnings and ends that one edit elsewhere would leave alone.

    A line of m words and one of m or m + 1 words within one edit share the first m // 2 words or the last m - m // 2.
    """
    n = F.size(w)
    low, high = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    part = lambda side, size, content: F.struct(F.lit(side).alias("side"), size.alias("size"), F.xxhash64(F.lit(side), content).alias("key"))
    first = lambda size: part(0, size, F.slice(w, 1, size))
    last = lambda size: part(1, size, F.slice(w, n - size + 1, size))
    # As the longer line, an even one also counts one word less at its beginning, an odd one at its end.
    return F.array(first(low), last(high), F.when(n % 2 == 0, first(low - 1)).otherwise(last(low)))


def _numbered(docs: DataFrame, shown) -> DataFrame:
    """(row_id, row_hash, line_no, line) of all lines, each as `shown` makes it."""
    # An outer explode: a plain one makes Spark compute the array a second time to filter empty ones.
    lines = F.transform(F.split("text", "\n"), shown)
    return texts(docs).select(row_id().alias("row_id"), text_hash().alias("row_hash"), F.posexplode_outer(lines).alias("line_no", "line"))


def _hashed(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines of `min_words` words or more, as words, with two hashes of them."""
    # Split before the explode: the filter on top of it then sees words that are made once.
    rows = _numbered(docs, words).withColumnRenamed("line", "words").filter(F.size("words") >= min_words)
    return rows.withColumns({"h1": F.xxhash64("words"), "h2": F.hash("words")})


def _variants(near: DataFrame) -> DataFrame:
    """(h1, h2, variant) of lines with their words and (side, size) halves that another line shares."""
    w, n = F.col("words"), F.size("words")
    # Places outside the shared half: after a beginning, before an end. A line itself has one place more.
    places = F.array_distinct(
        F.flatten(
            F.transform(
                "shared",
                lambda s: F.when(s["side"] == 0, F.sequence(s["size"], n)).otherwise(F.sequence(F.lit(0), n - s["size"])),
            )
        )
    )
    rows = near.select(*LINE, "words", F.explode_outer(places).alias("i"))
    without = F.when(F.col("i") < n, F.xxhash64(F.slice(w, 1, F.col("i")), F.slice(w, F.col("i") + 2, n)))
    # Hashes run through array elements one after the other, so two slices hash like the joined array.
    rows = rows.select(*LINE, "i", F.explode(F.array(without, F.xxhash64(w, F.array().cast("array<string>")))).alias("v"))
    return rows.filter("v IS NOT NULL").select(*LINE, F.xxhash64("v", "i").alias("variant"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion or substitution of a word, or none, turns array a into array b."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda x, start: F.slice(x, start, F.greatest(F.size(x) - start + 1, F.lit(0)))
    after = differ + 1
    one = (rest(a, after) == rest(b, after)) | (rest(a, after) == rest(b, differ)) | (rest(a, differ) == rest(b, after))
    return (differ == 0) | ((differ > 0) & one)


def dropped(docs: DataFrame, min_words: int = MIN_WORDS, min_words_near: int = MIN_WORDS_NEAR) -> DataFrame:
    """(row_id, row_hash, line_nos): the lines to drop, counted from 0, of the rows that have any.

    A line goes if an earlier one (by id, then line; rows without an id come first) is equal word for word or, among
    lines of `min_words_near` words or more, differs by one word. Lines are judged on the input, dropped ones too.
    """
    scanned = _hashed(docs, min_words)
    is_near = F.size("words") >= min_words_near
    keys = F.when(is_near, F.transform(_halves(F.col("words")), lambda h: h["key"]))
    lines = store(scanned.select(*PLACE, *LINE, keys.alias("keys")), "lines")
    classes = store(
        lines.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), F.any_value("keys").alias("keys")),
        "lines-classes",
    )

    # Distinct lines that share a half with another one.
    halves = classes.select(*LINE, F.explode("keys").alias("key"))
    met = halves.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = store(met, "lines-met")
    paired = halves.join(met, "key", "left_semi").groupBy(*LINE).agg(F.collect_set("key").alias("met"))
    paired = store(paired.join(classes.select(*LINE, "first"), LINE), "lines-paired")
    at = paired.select(*[F.col(f"first.{c}").alias(c) for c in PLACE], *LINE, "met")
    # Only the lines that are asked for are split again.
    near = join_small(_numbered(docs, lambda line: line), at, PLACE, "inner").withColumn("words", words("line")).dropDuplicates(LINE)
    shared = F.filter(_halves(F.col("words")), lambda h: F.array_contains("met", h["key"]))
    near = store(near.select(*LINE, F.struct(*PLACE).alias("first"), "words", shared.alias("shared")), "lines-near")

    variants = store(_variants(near), "lines-neighbourhood")
    again = variants.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1").select("variant")
    again = store(again, "lines-again")
    variants = store(variants.join(again, "variant", "left_semi"), "lines-variants")
    order = near.select(*LINE, "first")
    placed = store(variants.join(order, LINE), "lines-placed")
    earliest = store(placed.groupBy("variant").agg(F.min(F.struct("first", *LINE)).alias("lead")), "lines-earliest")
    pairs = placed.join(earliest, "variant").filter(F.col("lead.first") < F.col("first"))
    pairs = pairs.select(*LINE, F.col("lead.h1").alias("l1"), F.col("lead.h2").alias("l2")).distinct()
    lead = near.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("words").alias("lead_words"))
    verified = pairs.join(lead, ["l1", "l2"]).join(near.select(*LINE, "words"), LINE)
    verified = verified.filter(within_one_edit(F.col("words"), F.col("lead_words"))).select(*LINE).distinct()

    flagged = classes.select(*LINE, "first", "n").join(verified.withColumn("near", F.lit(True)), LINE, "left")
    flagged = store(flagged.filter("n > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-flagged")
    gone = join_small(lines.select(*PLACE, *LINE), flagged, LINE, "inner").filter(F.col("near") | (F.struct(*PLACE) > F.col("first")))
    return store(gone.groupBy(*ROW).agg(F.collect_set("line_no").alias("line_nos")), "lines-dropped")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_words_near: int = MIN_WORDS_NEAR) -> DataFrame:
    """`docs` with all its columns, its text without the dropped lines, and __n_lines and __n_removed.

    A null text has no line and stays null, an empty one has one empty line and stays empty; rows that agree in id and
    text count as one row; an empty table gives no rows; any other columns are passed through.
    """
    found = attach(docs, dropped(docs, min_words, min_words_near), "line_nos")
    found = found.withColumn("__lines", F.split("text", "\n"))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__payload"))
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return found.withColumns(
        {
            "text": F.when(F.col("__payload").isNull(), F.col("text")).otherwise(text),
            "__n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
            "__n_removed": F.when(F.col("__payload").isNull(), 0).otherwise(F.size("__payload")).cast("long"),
        }
    ).drop("__payload", "__lines")
