"""Secret scans: three base patterns, and candidate strings whose characters look drawn at random.

A candidate is a maximal run of one character class. A window slides over it and its Shannon entropy is kept up to
date by the counts of the character that leaves and of the one that enters; windows at or above the threshold of
the class are united to one span. What matches the allow-list is cut out of a candidate, so only windows that overlap
it are left alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import texts

# The base patterns and their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

SPAN = "array<struct<start:int,kind:int,end:int>>"


class CharacterClass(NamedTuple):
    """Characters of a class, its window and the bits a character must carry; `needs` must occur in a candidate."""

    chars: str
    window: int
    bits: float
    needs: str


#: The thresholds lie about half a bit under the mean entropy of random strings of the class.
CLASSES = (
    CharacterClass("0-9a-f", 24, 3.0, "(?=.*[0-9])(?=.*[a-f])"),
    CharacterClass("0-9A-F", 24, 3.0, "(?=.*[0-9])(?=.*[A-F])"),
    CharacterClass("A-Z0-9", 20, 3.5, "(?=.*[0-9])(?=.*[G-Z])"),
    CharacterClass("a-z0-9", 20, 3.5, "(?=.*[0-9])(?=.*[g-z])"),
    CharacterClass("A-Za-z0-9+/_=-", 20, 3.7, "(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    # No digit: letters alone are names more often than keys, so they must carry more.
    CharacterClass("A-Za-z+/_=-", 20, 3.9, "(?=.*[a-z])(?=.*[A-Z])"),
)
#: Random-looking but public: the word that holds an example, digests with their algorithm's name, alphabets, runs of one character.
ALLOWED = (
    r"(?i)[A-Za-z0-9+]*(?:example|sample|placeholder|dummy|changeme)[A-Za-z0-9+]*|sha(?:1|256|384|512)-[A-Za-z0-9+/=]*"
    r"|abcdefgh|12345678|(.)\1{7,}"
)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """[(start, end, group)] of all leftmost matches that do not overlap, in code points."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), group)
    found = F.arrays_zip(between.alias("gap"), whole.alias("size"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        end = begin + F.coalesce(m["size"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), m["value"].alias("value"))
        # What follows the last match has a gap and no match.
        return F.struct(end.alias("at"), F.when(m["size"].isNull(), state["out"]).otherwise(F.array_append(state["out"], span)).alias("out"))

    return F.aggregate(found, start, step, lambda state: state["out"])


def _spans(text: Column, kind: int, pattern: str, group: int, wanted) -> Column:
    """Spans of a base pattern; the costly part runs only where the text holds a match at all."""
    found = F.transform(
        F.filter(_matches(text, pattern, group), wanted),
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")),
    )
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


#: Characters of all classes lie from + to z. Their counts in a window, five bits each, share a few 64-bit numbers.
FIRST_CHAR, BITS, PER_NUMBER = ord("+"), 5, 12
NUMBERS = -(-(ord("z") - FIRST_CHAR + 1) // PER_NUMBER)
#: Terms of the entropy are whole multiples of this fraction of a bit, so that sums do not drift.
GRAIN = 1 << 32


def _hot_range(token: Column, size: int, bits: float) -> Column:
    """(first, last) start of the windows of `token` whose entropy reaches `bits`; both null if there is none.

    H = log2(size) - sum(c * log2 c) / size over the counts c of the window, so a shift by one character changes
    two terms of the sum and two counts. The token is taken apart once and read once: a step costs the same at any
    place of a token of any length.
    """
    if size >= 1 << BITS:
        raise ValueError(f"a window holds at most {(1 << BITS) - 1} characters")
    terms = [round(GRAIN * c * math.log2(c)) if c else 0 for c in range(size + 1)]
    # What one more character adds to a sum that has c of it.
    rises = F.array(*[F.lit(terms[c + 1] - terms[c]) for c in range(size)])
    most = math.floor(GRAIN * size * (math.log2(size) - bits)) + GRAIN // 1_000_000
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST_CHAR)

    def count(numbers: Column, code: Column) -> Column:
        number = F.get(numbers, F.floor(code / PER_NUMBER).cast("int"))
        return F.call_function("shiftright", number, (code % PER_NUMBER * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def moved(numbers: Column, code: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), (code % PER_NUMBER * BITS).cast("int"))
        return F.transform(numbers, lambda n, k: F.when(k == F.floor(code / PER_NUMBER).cast("int"), n + one).otherwise(n))

    def leave(s: Column, code: Column) -> Column:
        counts = moved(s["counts"], code, -1)
        return F.struct(counts.alias("counts"), (s["sum"] - F.get(rises, count(s["counts"], code) - 1)).alias("sum"), s["first"].alias("first"), s["last"].alias("last"))

    def enter(s: Column, x: Column) -> Column:
        total = s["sum"] + F.get(rises, count(s["counts"], x["new"]))
        hot = F.when((x["at"] >= size - 1) & (total <= most), x["at"] - (size - 1))
        return F.struct(
            moved(s["counts"], x["new"], 1).alias("counts"), total.alias("sum"), F.coalesce(s["first"], hot).alias("first"), F.coalesce(hot, s["last"]).alias("last")
        )

    def step(s: Column, x: Column) -> Column:
        # Before the new character enters, the one that stands `size` places before it leaves.
        old = F.array(F.get(x["codes"], x["at"] - size))
        return F.aggregate(F.filter(old, lambda c: c.isNotNull()), s, leave, lambda t: enter(t, x))

    none = F.lit(None).cast("int")
    start = F.struct(
        F.array(*[F.lit(0).cast("long")] * NUMBERS).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last")
    )
    # One list with the token's codes, so that they are made once; each step looks back into it.
    over = F.transform(F.array(codes), lambda cs: F.aggregate(
        F.transform(cs, lambda c, i: F.struct(c.alias("new"), i.alias("at"))), start,
        lambda s, x: step(s, F.struct(x["new"].alias("new"), x["at"].alias("at"), cs.alias("codes"))),
        lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
    ))
    return F.get(over, F.lit(0))


def _pieces(run: Column, allowed: str) -> Column:
    """[(start, value)] of what is left of a candidate when the allow-list's matches are cut out."""
    whole = F.transform(F.regexp_extract_all(run["value"], F.lit(allowed), 0), lambda x: F.length(x))
    parts = F.arrays_zip(F.split(run["value"], allowed, -1).alias("value"), whole.alias("size"))
    start = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        piece = F.struct(state["at"].alias("start"), p["value"].alias("value"))
        at = state["at"] + F.length(p["value"]) + F.coalesce(p["size"], F.lit(0))
        return F.struct(at.alias("at"), F.array_append(state["out"], piece).alias("out"))

    cut = F.aggregate(parts, start, step, lambda state: state["out"])
    return F.when(run["value"].rlike(allowed), cut).otherwise(F.array(F.struct(run["start"].alias("start"), run["value"].alias("value"))))


def _entropy_spans(text: Column, c: CharacterClass, allowed: str) -> Column:
    pattern = f"[{c.chars}]{{{c.window},}}"
    fine = lambda m: (F.length(m["value"]) >= c.window) & m["value"].rlike(c.needs)
    pieces = F.flatten(F.transform(_matches(text, pattern, 0), lambda m: _pieces(m, allowed)))
    ranged = F.transform(
        F.filter(pieces, fine), lambda m: F.struct(m["start"].alias("start"), _hot_range(m["value"], c.window, c.bits).alias("hot"))
    )
    spans = F.transform(
        F.filter(ranged, lambda r: r["hot"]["first"].isNotNull()),
        lambda r: F.struct(
            (r["start"] + r["hot"]["first"]).alias("start"),
            F.lit(KINDS.index("entropy")).alias("kind"),
            (r["start"] + r["hot"]["last"] + c.window).alias("end"),
        ),
    )
    return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: str = ALLOWED) -> DataFrame:
    """(doc_id, text, spans): spans of every kind by start, then by the order of KINDS, as (start, kind, end).

    Positions count code points, ends are exclusive. Patterns of a kind do not overlap themselves, kinds may. A null
    or empty text has no span. Repeated rows are scanned one by one, extra columns are ignored.
    """
    text = F.col("text")
    base = [
        _spans(text, 0, ASSIGN, 2, lambda m: F.length(m["value"]) >= 6),
        _spans(text, 1, ACCESS, 0, lambda m: m["end"] - m["start"] >= 20),
        # Runs are maximal, so a shorter run can be passed over by the pattern itself.
        _spans(text, 2, "[0-9a-f]{24,}", 0, lambda m: F.lit(True)),
    ]
    found = F.flatten(F.array(*base, F.array_distinct(F.flatten(F.array(*[_entropy_spans(text, c, allowed) for c in classes])))))
    return texts(docs).select("doc_id", "text", F.sort_array(found).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
