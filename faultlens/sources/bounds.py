"""What a read is about: instants and cases as literals, which reach the scan and prune row groups and folders."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens import constants as K

#: Most cases whose windows and ids become literals; of more, one range from the first window to the last is left.
MOST_CASES = 256
#: Raw instants are numbers of these units a second.
UNITS = (1, 1_000, 1_000_000, 1_000_000_000)
#: Seconds around a range that a raw column may differ by rounding.
SLACK = 0.001


@dataclass(frozen=True)
class Bounds:
    """Disjoint ranges of epoch seconds, ends included, and the ids of the cases if they are few."""

    ranges: tuple[tuple[float, float], ...]
    cases: tuple[str, ...] | None = None

    def of_instants(self, ts: Column) -> Column:
        """Whether an instant in seconds lies in a range."""
        return reduce(or_, [ts.between(lo, hi) for lo, hi in self.ranges], F.lit(False))

    def of_cases(self, case_id: Column) -> Column:
        return F.lit(True) if self.cases is None else case_id.isin(*self.cases)

    def of_raw(self, df: DataFrame, columns: Iterable[str]) -> Column | None:
        """A condition on raw time columns that holds wherever one of them may lie in a range.

        Numbers count in any of the usual units, instants as such. Text is no range of anything, so a column of text
        leaves no condition (None).
        """
        tests = []
        for name in columns:
            kind = df.schema[name].dataType
            column = F.col(f"`{name}`")
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                edge = lambda s, kind=kind: F.timestamp_micros(F.lit(round(s * 1e6))).cast(kind)
                tests += [(column >= edge(lo - SLACK)) & (column <= edge(hi + SLACK)) for lo, hi in self.ranges]
            elif isinstance(kind, T.IntegralType):
                most = (1 << {"tinyint": 7, "smallint": 15, "int": 31}.get(kind.simpleString(), 63)) - 1
                clip = lambda v, kind=kind, most=most: F.lit(max(-most, min(most, v))).cast(kind)
                tests += [
                    (column >= clip(math.floor((lo - SLACK) * u))) & (column <= clip(math.ceil((hi + SLACK) * u))) for lo, hi in self.ranges for u in UNITS
                ]
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                # A float's own rounding is wider than any slack in seconds.
                wide = 256.0 if isinstance(kind, T.FloatType) else SLACK
                tests += [(column >= F.lit((lo - wide) * u).cast(kind)) & (column <= F.lit((hi + wide) * u).cast(kind)) for lo, hi in self.ranges for u in UNITS]
            else:
                return None
        return reduce(or_, tests) if tests else None


def united(ranges: Iterable[tuple[float, float]]) -> tuple[tuple[float, float], ...]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return tuple(out)


def bounds_of(
    cases: DataFrame, baseline_seconds: float = K.BASELINE_SECONDS, incident_seconds: float = K.INCIDENT_SECONDS, most: int = MOST_CASES
) -> Bounds:
    """Bounds of the windows of all cases: theirs exactly if they are few, else their hull. Runs a job over `cases`."""
    known = cases.filter(F.col("inject_time").isNotNull()).select("case_id", F.col("inject_time").cast("double").alias("t"))
    few = known.distinct().limit(most + 1).collect()
    window = lambda a, b: (a - baseline_seconds, b + incident_seconds)
    if len(few) <= most:
        return Bounds(united(window(r["t"], r["t"]) for r in few), tuple(sorted({r["case_id"] for r in few if r["case_id"] is not None})))
    ends = known.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return Bounds((window(ends["a"], ends["b"]),))
