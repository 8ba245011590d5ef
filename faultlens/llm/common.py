"""What the operators share: reading tables, cutting lineage, joins with a small side of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import prepare
from faultlens.plans.materialize import materialize

#: Words of a text: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Most bytes that a join may broadcast; above it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more...) of a table; a null text is the empty one, other columns stay behind.

    Every operator starts here, so this sets what they rely on: joins whose hot keys Spark may split, and few rows at
    once for Python workers, as a text may be megabytes long.
    """
    prepare(docs.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words(text: str | Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Also for the keys that a join looks for: Spark splits a hot key of a join, but not where the other side comes
    straight out of an aggregate over the same key.
    """
    return materialize(df, f"llm-{label}", None)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int = 64) -> DataFrame:
    """Join with a stored table: broadcast if its counted rows fit the limit, else shuffled and split by AQE."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def text_hash(text: str | Column = "text") -> Column:
    """With doc_id it names a row; rows that agree in both are copies of one row."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose (doc_id, text_hash) is among `kept`; null ids count too."""
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash"))
    same = docs["doc_id"].eqNullSafe(kept["__kept_id"]) & (text_hash(docs["text"]) == kept["__kept_hash"])
    return docs.join(kept, same, "left_semi")


#: The row of a documents table: its id (the least long where there is none) and the hash of its text.
ROW = ["row_id", "row_hash"]


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def attach(docs: DataFrame, found: DataFrame, payload: str, row_bytes: int = 256) -> DataFrame:
    """`docs` with all its columns, and `payload` of the stored (row_id, row_hash, payload) where there is one."""
    keyed = docs.withColumns({"__row_id": row_id(), "__row_hash": text_hash()})
    found = found.select(F.col("row_id").alias("__row_id"), F.col("row_hash").alias("__row_hash"), F.col(payload).alias("__payload"))
    joined = join_small(keyed, found, ["__row_id", "__row_hash"], "left", row_bytes)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__payload")
