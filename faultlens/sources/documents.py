"""JSON documents larger than one task should hold.

Spark's text source cuts a file at a closing bracket instead of a line break, so a document is split among tasks like
any text. Whether a piece begins inside a string, and how deep it lies, depends on everything before it: both are
running values, so a split passes on one small row. A piece never begins within an escape, as JSON knows no `\\]` or
`\\}`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.plans.ordering import line_chunk, running

DOC = "__doc"
RUN = "__run"
MARK = "\0run"
_SPLIT, _ROW, _NO = "__split", "__row", "__no"
# What an innermost array holds: no brackets or braces outside its strings.
_FLAT = r'\[((?:[^\[\]{}"\\]++|"(?:[^"\\]++|\\.)*+")*+)\z'


def _count(text, chars: str):
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def _pieces(scan: DataFrame) -> DataFrame:
    """Pieces of documents (case_id, value), numbered from 1 in each, and whether they start and end inside a string."""
    rows = scan.select(
        "case_id", "value",
        F.col("_metadata.file_path").alias(DOC),
        F.col("_metadata.file_block_start").alias(_SPLIT),
        F.monotonically_increasing_id().alias(_ROW),
        F.regexp_replace("value", r"(?s)\\.", "").alias("bare"),
    ).withColumn("quotes", _count(F.col("bare"), '"'))
    sums = {_NO: F.lit(1).cast("bigint"), "upto": F.col("quotes")}
    numbered = running(rows, [DOC], [_ROW], F.col(_SPLIT), sums=sums, store="pieces")
    inside = {"starts_inside": (F.col("upto") - F.col("quotes")) % 2 == 1, "ends_inside": F.col("upto") % 2 == 1}
    return numbered.withColumns(inside).drop("quotes", "upto", _SPLIT, _ROW)


def _whole_strings(pieces: DataFrame, end: str) -> DataFrame:
    """Pieces that end outside strings: those that a bracket inside a string has cut are put together again."""
    columns = ["case_id", DOC, _NO, "value"]
    cut = F.col("starts_inside") | F.col("ends_inside")
    begin = F.when(~F.col("starts_inside"), F.col(_NO))
    parts = running(pieces.filter(cut), [DOC], [_NO], line_chunk(_NO), upto_max={"begin": begin}, store="strings")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(_NO, "value"))), lambda p: p["value"]), end)
    joined = parts.groupBy("case_id", DOC, F.col("begin").alias(_NO)).agg(text.alias("value"))
    return pieces.filter(~cut).select(*columns).unionByName(joined.select(*columns))


def split_arrays(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without their points, and the points, of a text scan with `lineSep` "]".

    A point is an array of plain values in an array that begins with one and holds nothing else; other arrays stay in
    the document as they are. In the documents (case_id, __doc, value), which must be objects or arrays of objects, each array of points
    is `[MARK, run, place]`; points are (__doc, __run, place, value), their places ascending by one from their array's.
    A document keeps its names and labels only, and those are one row's.
    """
    flat = F.regexp_extract("value", _FLAT, 1)
    rows = (
        _whole_strings(_pieces(scan), "]")
        .withColumn("flat", F.when(F.col("value").rlike(_FLAT), flat))
        .withColumn("head", F.expr("left(value, length(value) - length(flat) - 1)"))
        .withColumn("first", F.coalesce(F.col("head").rlike(r"\[\s*\z"), F.lit(False)))
        .withColumn("next", F.coalesce(F.col("head").rlike(r"\A\s*,\s*\z"), F.lit(False)))
    )
    # The last piece that is no further point: 2 x its number, and 1 if points begin with it.
    turn = F.when(~F.col("next"), F.col(_NO) * 2 + F.col("first").cast("bigint"))
    one = {"place": F.lit(1).cast("bigint")}
    rows = running(rows, [DOC], [_NO], line_chunk(_NO), sums=one, prior_max={"turn": turn}, store="arrays")
    in_run = F.coalesce(F.col("turn") % 2 == 1, F.lit(False))
    further, ends_run = F.col("next") & in_run, in_run & F.col("value").rlike(r"\A\s*\z")
    start = F.when(F.col("first"), F.col(_NO)).when(further, F.floor(F.col("turn") / 2))
    points = rows.withColumn(RUN, start).filter(F.col(RUN).isNotNull()).select(
        DOC, RUN, "place", F.concat(F.lit("["), "flat", F.lit("]")).alias("value")
    )
    mark = F.concat(F.lit('["\\u0000run",'), _NO, F.lit(","), "place", F.lit("]"))
    kept = F.when(F.col("first"), F.concat(F.regexp_replace("head", r"\[\s*\z", ""), mark)).otherwise(F.concat("value", F.lit("]")))
    parts = F.sort_array(F.collect_list(F.struct(_NO, kept.alias("t"))))
    whole = F.array_join(F.transform(parts, lambda p: p["t"]), "")
    # The text after the last bracket is a piece too, which no bracket ended.
    trimmed = F.when(F.col("value").rlike(r"\A\s*\{"), F.regexp_replace("value", r"\]\z", "")).otherwise(
        F.regexp_replace("value", r"\](\s+)\]\z", "]$1")
    )
    docs = rows.filter(~further & ~ends_run).groupBy("case_id", DOC).agg(whole.alias("value")).withColumn("value", trimmed)
    return docs, points


def split_objects(scan: DataFrame) -> DataFrame:
    """The objects (case_id, __doc, value) in arrays of a document's top level, of a text scan with `lineSep` "}".

    An object is one row. Strings before the first array must hold no opening brace.
    """
    opening = F.when(F.col("starts_inside"), F.lit('"')).otherwise(F.lit(""))
    outside = F.regexp_replace(F.concat(opening, "bare"), r'"[^"]*+(?:"|\z)', "")
    rows = _pieces(scan).withColumn("outside", outside).drop("bare")
    sums = {
        "opened": _count(F.col("outside"), "[{"),
        "closed": _count(F.col("outside"), "]}") + (~F.col("ends_inside")).cast("bigint"),
    }
    rows = running(rows, [DOC], [_NO], line_chunk(_NO), sums=sums, store="depths")
    rows = rows.withColumn("depth", F.col("opened") - F.col("closed")).drop("opened", "closed", "outside")
    ends = (~F.col("ends_inside")) & (F.col("depth") == 2)
    rows = rows.filter(F.col("depth") >= 2)
    rows = running(rows, [DOC], [_NO], line_chunk(_NO), sums={"upto": ends.cast("bigint")}, store="objects")
    text = F.when(F.col(_NO) == 1, F.regexp_replace("value", r"\A\s*\{", "")).otherwise(F.col("value"))
    parts = F.sort_array(F.collect_list(F.struct(_NO, F.concat(text, F.lit("}")).alias("t"))))
    whole = F.array_join(F.transform(parts, lambda p: p["t"]), "")
    element = (F.col("upto") - ends.cast("bigint")).alias("element")
    return rows.groupBy("case_id", DOC, element).agg(whole.alias("value")).select(
        "case_id", DOC, F.regexp_replace("value", r"\A[^{]*+", "").alias("value")
    )
