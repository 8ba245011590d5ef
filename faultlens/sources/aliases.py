"""Column aliases of raw files and service-name variants."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions import clock
from faultlens.plans.materialize import materialize
from faultlens.sources.bounds import Bounds

ROW = "__row"


#: Columns of a CSV file that are looked at.
CSV_WIDTH = 64


def aliases_in(columns: list[str], candidates) -> list[str]:
    """The candidates among `columns`, best first, in the spelling of `columns`."""
    present = {c.strip().lower(): c for c in columns}
    return [present[c.lower()] for c in candidates if c.lower() in present]


def case_from_path(file_name: str) -> Column:
    """Case id = the folder a file (or a folder written in its place) lies in."""
    stem = file_name.replace(".", r"\.")
    return F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), rf"([^/]+)/{stem}(?:/[^/]+)?$", 1)


def folders(within: Bounds | None) -> str:
    """Glob of the case folders to read: those asked for if they are few, else all."""
    if within is None or within.cases is None:
        return "*"
    return "{" + ",".join(re.sub(r"([\\{}\[\]*?,])", r"\\\1", c) for c in within.cases) + "}"


def scan(
    spark: SparkSession, root: str, file_name: str, fmt: str, layout: str, schema: str | None = None, within: Bounds | None = None, **options: str
) -> DataFrame:
    """Read one kind of file of all cases and add `case_id`, and the row's place unless it is plain text.

    `folders`: root/<case>/<file_name>. `partitioned`: root/<file_name>/case_id=<case>/…. With `within`, folders of
    other cases are not opened.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema + ", case_id string" * (layout == "partitioned"))
    if layout == "partitioned":
        df = reader.load(f"{root}/{file_name}")
        if within is not None:
            df = df.filter(within.of_cases(F.col("case_id").cast("string")))
        df = df.withColumn("case_id", F.col("case_id").cast("string"))
    else:
        df = reader.load(f"{root}/{folders(within)}/{file_name}").withColumn("case_id", case_from_path(file_name))
    return df if fmt == "text" else df.withColumn(ROW, row_position(fmt))


def scan_columns(
    spark: SparkSession, root: str, file_name: str, fmt: str, layout: str, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...], multi_line: bool = True, by_name: tuple[str, ...] = (),
    within: Bounds | None = None,
) -> tuple[DataFrame, dict[str, list[tuple[str, Column]]]]:
    """The rows of all cases and, for each wanted column, the (name, column) pairs that may hold it, best first.

    Cases may name their columns differently. Parquet files are read under their merged schema, so a row has values
    in its own file's columns only. CSV files each have their own header, which is found by its aliases for the
    `required` columns; a file without one gives no rows. The names of `by_name` columns tell what is in them.
    """
    if fmt != "csv":
        df = scan(spark, root, file_name, fmt, layout, within=within, mergeSchema="true")
        at = {k: [(c, F.col(f"`{c}`")) for c in aliases_in(df.columns, names)] for k, names in wanted.items()}
        return in_bounds(df, [c for c, _ in at.get("time", [])], within), at
    cells = [f"__c{i}" for i in range(CSV_WIDTH)]
    options = {"header": "false", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE"}
    # One column more than is read: the parser then picks columns by place and fills a short row with nulls. Asked for
    # all of them, it throws and catches an exception for every column that a row lacks.
    declared = ", ".join(f"{c} string" for c in (*cells, "__spare"))
    raw = scan(spark, root, file_name, "csv", layout, declared, within, columnPruning="true", **options).drop("__spare")
    raw = raw.withColumns({"__file": F.col("_metadata.file_path"), "__cells": F.array(*cells)}).drop(*cells)
    bare = F.transform("__cells", lambda c: F.lower(F.btrim(c, F.lit(" \t\ufeff"))))
    is_header = reduce(and_, [F.arrays_overlap(bare, F.array(*[F.lit(a.lower()) for a in wanted[k]])) for k in required])
    heads = raw.filter(F.coalesce(is_header, F.lit(False))).groupBy("__file").agg(F.min(ROW).alias("__head"), F.min_by(bare, ROW).alias("__names"))
    named = {k: F.coalesce(*[F.when(F.array_contains("__names", a.lower()), F.lit(a)) for a in names]) for k, names in wanted.items()}
    heads = heads.withColumns({f"__name_{k}": c for k, c in named.items()})
    heads = heads.withColumns({f"__at_{k}": F.array_position("__names", F.lower(f"__name_{k}")).cast("int") - 1 for k in wanted})
    # One row per file: joined back by its size, which Spark knows once it is written.
    df = raw.join(materialize(heads.drop("__names"), "headers"), "__file").filter(F.col(ROW) != F.col("__head"))
    cell = lambda k: F.get("__cells", F.col(f"__at_{k}"))
    return df, {k: [(a, F.when(F.col(f"__name_{k}") == a, cell(k))) for a in names] if k in by_name else [(k, cell(k))] for k, names in wanted.items()}


def in_bounds(df: DataFrame, times: list[str], within: Bounds | None) -> DataFrame:
    """Raw rows of which a time column may lie in the bounds; rows are held against them exactly once they have `ts`."""
    test = None if within is None else within.of_raw(df, times)
    return df if test is None else df.filter(test)


def prefer(better: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of `better`, and those of `other` whose case has none there."""
    return better.unionByName(other.join(better.select("case_id").distinct(), "case_id", "left_anti"))


def missing(error: AnalysisException) -> bool:
    """Whether a read failed because there is no such file."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def first_of(found: list[tuple[str, Column]]) -> Column:
    """First value among columns that may hold it, as text."""
    return F.coalesce(*[c.cast("string") for _, c in found]) if found else F.lit(None).cast("string")


def instant(df: DataFrame, found: list[tuple[str, Column]]) -> Column:
    """Epoch seconds of the first raw time column with a value; null where there is none or it cannot be read."""

    def one(name: str, column: Column) -> Column:
        kind = df.schema[name].dataType if name in df.columns else T.StringType()
        if isinstance(kind, T.NumericType):
            seconds = clock.epoch_seconds(column)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            seconds = F.unix_micros(column.cast("timestamp")) / 1e6
        else:
            seconds = clock.parse_ts(column)
        return F.when(column.isNotNull(), seconds)

    return F.coalesce(*[one(n, c) for n, c in found])


def row_position(fmt: str) -> Column:
    """Place of a row for breaking ties, in file order.

    Parquet knows the row's index, which keeps the scan open for filters on its columns; text formats do not.
    """
    if fmt != "parquet":
        return F.monotonically_increasing_id()
    file_part = F.shiftleft(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 22)), 40)
    return file_part + F.col("_metadata.row_index")


def alias_table(names: DataFrame) -> DataFrame:
    """(alias, canonical) for every service name and its variant without SDK settings."""
    variants = F.array("service", F.concat(F.lit("unknown_service:"), F.col("service")))
    return names.select(F.col("service").alias("canonical"), F.explode(variants).alias("alias"))


def canonical_service(df: DataFrame, alias: DataFrame) -> DataFrame:
    """Replace known variants of a service name by the name itself."""
    return (
        df.join(alias.withColumnRenamed("alias", "service"), "service", "left")
        .withColumn("service", F.coalesce("canonical", "service"))
        .drop("canonical")
        .select(*df.columns)
    )
