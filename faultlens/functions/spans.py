"""Span columns: service, parent, error facts, status tags, ids and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions.text import contains_any

TAGS = "array<struct<key:string,value:string>>"
SPAN_LOGS = "array<struct<fields:array<struct<key:string,value:string>>>>"
INTEGER = r"^\s*[+-]?\d+\s*$"


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def span_service(tags: Column) -> Column:
    named = F.filter(tags, lambda t: t["key"].isin(*K.SERVICE_TAGS))
    first = F.get(named, F.lit(0))
    return F.when(first.isNull(), F.lit(K.UNKNOWN_SERVICE)).otherwise(
        F.trim(F.coalesce(first["value"], F.lit("")))
    )


def parent_of(references: Column) -> Column:
    """Span id of the first causal reference."""
    causal = F.filter(references, lambda r: r["refType"].isin("CHILD_OF", "FOLLOWS_FROM"))
    return F.get(causal, F.lit(0))["spanID"]


def span_error(tags: Column, logs: Column) -> Column:
    """is_error, status_code, error_code, error_message of a span; the last matching tag wins."""
    tags = F.coalesce(tags, F.array().cast(TAGS))
    fields = F.flatten(
        F.transform(
            F.coalesce(logs, F.array().cast(SPAN_LOGS)),
            lambda e: F.coalesce(e["fields"], F.array().cast(TAGS)),
        )
    )
    flagged = F.exists(
        tags,
        lambda t: F.lower(t["key"]).isin(*K.ERROR_FLAG_TAGS) & F.lower(t["value"]).isin("true", "error"),
    )
    codes = F.transform(
        F.filter(tags, lambda t: F.lower(t["key"]).isin(*K.STATUS_TAGS) & t["value"].rlike(INTEGER)),
        lambda t: F.trim(t["value"]).try_cast("int"),
    )
    bad_code = F.exists(codes, lambda c: (c >= 500) | c.isin(*K.GRPC_ERROR_CODES))
    messages = F.filter(tags, lambda t: F.lower(t["key"]).isin(*K.MESSAGE_TAGS))
    error_codes = F.filter(tags, lambda t: F.lower(t["key"]).isin(*K.CODE_TAGS))
    logged = F.filter(fields, lambda f: f["key"].isin("message", "error.message"))
    error_event = F.exists(fields, lambda f: (f["key"] == "event") & (F.lower(f["value"]) == "error"))
    is_error = flagged | bad_code | (F.size(logged) > 0) | error_event
    return F.struct(
        F.coalesce(is_error, F.lit(False)).alias("is_error"),
        _last(codes).alias("status_code"),
        _last(error_codes)["value"].alias("error_code"),
        F.coalesce(_last(logged)["value"], _last(messages)["value"]).alias("error_message"),
    )


def is_timeout(error: Column) -> Column:
    """Error struct of `span_error` that reports an expired deadline."""
    text = F.lower(
        F.concat(F.coalesce(error["error_code"], F.lit("")), F.lit(" "), F.coalesce(error["error_message"], F.lit("")))
    )
    by_code = F.coalesce(error["status_code"].isin(*K.TIMEOUT_CODES), F.lit(False))
    return error["is_error"] & (by_code | contains_any(text, K.TIMEOUT_WORDS))


def status_tags(status: Column, fmt: str = "parquet") -> Column:
    """Raw status → error tag and numeric status tag, as an array that may be empty."""
    words = K.ERROR_STATUS_WORDS_CSV if fmt == "csv" else K.ERROR_STATUS_WORDS
    st = F.lower(F.trim(status.cast("string")))
    empty = F.array().cast(TAGS)
    tag = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    error = F.when(st.isin(*words), tag("error", F.lit("true"))).otherwise(empty)
    code = F.when(
        st.rlike(r"^[0-9]+$"), tag("http.status_code", st.try_cast("bigint").cast("string"))
    ).otherwise(empty)
    return F.concat(error, code)


def clean_parent(parent: Column) -> Column:
    p = F.trim(parent.cast("string"))
    return F.when(~p.isin(*K.NULL_PARENTS), p)


def duration_us(value: Column, name: str, fmt: str = "parquet") -> Column:
    """Raw duration → µs. Only CSV columns named in ms are scaled, and only small values."""
    v = value.cast("string").try_cast("double")
    if fmt == "csv" and "ms" in name.lower():
        v = F.when(v < 100000, v * 1000).otherwise(v)
    return F.coalesce(v.try_cast("bigint"), F.lit(0).cast("bigint"))


def positive_ms(duration: Column) -> Column:
    return F.when(duration > 0, duration / 1000.0).otherwise(F.lit(0.0))
