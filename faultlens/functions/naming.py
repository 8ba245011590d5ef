"""Names: metric and span services, metric kinds, ids, fault labels, ground truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions.text import contains_any, strip


def metric_service(name: Column, query: Column) -> Column:
    """Service a metric belongs to: slash prefix, label value, underscore prefix, else `system`."""
    slash = strip(F.split_part(name, F.lit("/"), F.lit(1)))
    labelled = F.concat(name, F.lit(" "), F.coalesce(query, F.lit("")))
    double_quoted = F.regexp_extract(labelled, K.LABEL_KEYS + '="([^"]+)"', 1)
    single_quoted = F.regexp_extract(labelled, K.LABEL_KEYS + "='([^']+)'", 1)
    prefix = F.split_part(name, F.lit("_"), F.lit(1))
    return (
        F.when(name.contains("/") & (slash != ""), slash)
        .when(double_quoted != "", strip(double_quoted))
        .when(single_quoted != "", strip(single_quoted))
        .when(name.contains("_") & ~prefix.isin(*K.GENERIC_METRIC_PREFIXES), prefix)
        .otherwise(F.lit("system"))
    )


def bucket_service(name: Column) -> Column:
    """Simpler rule of the time buckets: slash prefix or `system`."""
    return F.when(name.contains("/"), F.split_part(name, F.lit("/"), F.lit(1))).otherwise(F.lit("system"))


def metric_kind(name: Column) -> Column:
    """Flags `memory`, `latency` and `limit` by substring."""
    low = F.lower(name)
    return F.struct(
        contains_any(low, K.MEMORY_MARKS).alias("memory"),
        contains_any(low, K.LATENCY_MARKS).alias("latency"),
        contains_any(low, K.LIMIT_MARKS).alias("limit"),
    )


def incident_id(run_id: Column) -> Column:
    """Opaque id, so that a context never names the faulty service."""
    return F.concat(F.lit("INC-"), F.upper(F.substring(F.sha2(run_id, 256), 1, 8)))


def fault_category(label: Column) -> Column:
    cleaned = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    pairs = [F.lit(x) for kv in K.FAULT_TO_CATEGORY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cleaned), F.lit(K.UNKNOWN_CATEGORY))


def fault_matches(predicted: Column, label: Column) -> Column:
    truth = fault_category(label)
    return (truth != K.UNKNOWN_CATEGORY) & (F.coalesce(predicted, F.lit("")) == truth)


def fault_label(label: Column) -> Column:
    pairs = [F.lit(x) for kv in K.FAULT_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def error_bucket(top1: Column, top3: Column, fault: Column) -> Column:
    return (
        F.when(top1 & fault, F.lit("hit"))
        .when(top1, F.lit("category_miss"))
        .when(~fault, F.lit("localization_and_category_miss"))
        .when(top3, F.lit("ranking_miss"))
        .otherwise(F.lit("localization_miss"))
    )


def suite_of(case_id: Column) -> Column:
    return F.when(case_id.contains("_"), F.upper(F.split_part(case_id, F.lit("_"), F.lit(1)))).otherwise(
        F.lit("UNKNOWN")
    )


def truth_from_id(case_id: Column) -> Column:
    """Ground truth spelled in a case id: `ds_svc_fault_n` or `ds_bench_svc_fault[_n]`."""
    parts = F.split(case_id, "_")
    n = F.size(parts)
    last_is_number = F.try_element_at(parts, F.lit(-1)).rlike(r"^\d+$")
    short = (n == 4) & last_is_number
    part = lambda i: F.get(parts, F.lit(i))
    unknown = F.lit("unknown")
    return F.struct(
        F.when(n < 4, unknown).when(short, part(1)).otherwise(part(2)).alias("service"),
        F.upper(F.when(short, part(2)).when(n >= 4, part(3))).alias("fault_upper"),
        F.when((n >= 4) & ~short, part(1)).otherwise(unknown).alias("benchmark"),
        part(0).alias("dataset"),
    )
