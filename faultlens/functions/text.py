"""Log text: keywords, probes, stack traces, masking, tokens, fixed-point numbers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import constants as K

BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def contains_any(text: Column, marks) -> Column:
    return reduce(or_, [text.contains(m) for m in marks])


def match_keyword(line: Column) -> Column:
    """First error keyword in list order, or null."""
    low = F.lower(line)
    return F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in K.ERROR_KEYWORDS])


def is_probe(line: Column) -> Column:
    return contains_any(F.lower(line), K.PROBE_MARKS)


def correlation_tag(line: Column) -> Column:
    keyed = F.regexp_extract(line, K.KEYED_ID, 1)
    bracketed = F.regexp_extract(line, K.BRACKETED_ID, 1)
    return F.lower(F.coalesce(F.nullif(keyed, F.lit("")), F.nullif(bracketed, F.lit(""))))


def is_continuation(line: Column) -> Column:
    """Line that carries on a stack trace; a blank line never does."""
    low = F.lower(strip(line))
    starts = reduce(or_, [low.startswith(p) for p in K.STACK_PREFIXES])
    indented = line.startswith("  ") | line.startswith("\t")
    return (low != "") & (indented | starts | contains_any(low, K.STACK_MARKS))


# Every address holds this; looking for it first spares most lines the long pattern.
ADDRESS_HINT = r"[0-9]\.[0-9]{1,3}\.[0-9]"


def mask_line(line: Column) -> Column:
    # (?U) gives digits and word borders their Unicode meaning, so "é5" is one word.
    for pattern, name in K.MASKS:
        masked = F.regexp_replace(line, F.lit("(?U)" + pattern), F.lit(name))
        line = F.when(line.rlike(ADDRESS_HINT), masked).otherwise(line) if name == "<<IP>>" else masked
    return line


def _spaced(masked: Column) -> Column:
    """Delimiters as spaces, single spaces only."""
    spaced = F.translate(masked, K.TOKEN_DELIMITERS, " " * len(K.TOKEN_DELIMITERS))
    return strip(F.regexp_replace(spaced, F.lit(r"(?U)\s+"), F.lit(" ")))


def tokenize(masked: Column) -> Column:
    return F.filter(F.split(_spaced(masked), " "), lambda t: t != "")


def signature(line: Column) -> Column:
    """Masked tokens of a line as one string: the key of the relational templates."""
    return _spaced(mask_line(strip(line)))


def est_tokens(text: Column, chars: int = 4) -> Column:
    return tokens_for_length(F.length(text), chars)


def tokens_for_length(length: Column, chars: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(length / F.lit(chars))).cast("bigint")


def truncate_tokens(text: Column, max_tokens: Column, full_length: Column | None = None) -> Column:
    """Cut text to a token count (3 characters each) and mark the cut.

    `full_length` is the length of the whole text when `text` holds only its beginning.
    """
    length = F.length(text) if full_length is None else full_length
    suffix_tokens = max(1, len(K.TRUNCATED_SUFFIX) // 3)
    room = F.greatest(F.lit(1), max_tokens - F.lit(suffix_tokens + 2))
    keep = F.greatest(F.lit(20), room * F.lit(3)).cast("int")
    return F.when(tokens_for_length(length, 3) <= max_tokens, text).otherwise(
        F.concat(F.substring(text, F.lit(1), keep), F.lit(K.TRUNCATED_SUFFIX))
    )


def fixed(value: Column, digits: int, plus: bool = False) -> Column:
    """Fixed-point text, rounding the binary value half to even as C's printf does.

    Six decimals are settled first: the last bits of a sum depend on the order of its rows.
    """
    text = F.replace(F.format_number(F.round(value, 6), digits), F.lit(","), F.lit(""))
    if plus:
        text = F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text)
    return text
