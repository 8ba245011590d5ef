"""Instants: epoch normalisation, parsing and the `[iso] message` line format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}"


def epoch_seconds(value: Column) -> Column:
    """Epoch number in s, ms, µs or ns → seconds, judged per value by its size."""
    v = value.cast("double")
    return (
        F.when(v.isNull(), F.lit(0.0))
        .when(v > 1e16, v / 1e9)
        .when(v > 1e13, v / 1e6)
        .when(v > 1e10, v / 1e3)
        .otherwise(v)
    )


def parse_ts(text: Column) -> Column:
    """Number or ISO-like text → epoch seconds; zone-less text is UTC, unreadable text is null."""
    t = F.trim(text.cast("string"))
    number = F.when(t.rlike(NUMBER), t.try_cast("double"))
    instant = F.when(t.rlike(DATE_LIKE), t.try_cast("timestamp"))
    return (
        F.when(text.isNull(), F.lit(0.0))
        .when(number.isNotNull(), epoch_seconds(number))
        .otherwise(F.unix_micros(instant) / 1e6)
    )


def iso_instant(ts: Column) -> Column:
    """Epoch seconds → ISO-8601 with offset; the fraction is left out when it is zero."""
    micros = F.round(ts * 1e6).cast("bigint")
    stamp = F.timestamp_micros(micros)
    return F.when(
        F.pmod(micros, F.lit(1000000)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def format_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), iso_instant(ts), F.lit("] "), message)


def line_ts(line: Column) -> Column:
    """Instant a formatted line starts with; null when it has none."""
    inner = F.regexp_extract(line, r"^\[([^\]]+)\]", 1)
    return F.when(inner != "", parse_ts(inner))
