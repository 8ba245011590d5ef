"""Fill-in-middle transformation: texts cut in three and put together in another order.

A text is read by one fullmatch of a repeated capture, `(unit)*`: the match keeps where every repetition ended, so
its list of ends has one entry per unit and the ends at the two drawn counts are the cuts. Draws come from a hash of
the document id: a retried task cuts the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import texts

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One code point.
UNIT = r"(?s:.)"
SEED = 1
#: Of 100: texts left plain from here on, and texts of the rest whose suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Most repetitions that one match keeps (the regex library needs some 250 bytes for each); a longer text takes a
#: further match from where the last one ended.
MATCH_UNITS = 1 << 18


def draws(doc_id: str | Column = "doc_id", seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document; one without an id takes those of the empty id."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


class Units:
    """Repeated captures of a unit."""

    def __init__(self, unit: str):
        self.whole = regex.compile(f"({unit})*+(?s:.*)")
        self.part = regex.compile(f"({unit}){{1,{MATCH_UNITS}}}+")

    def ends(self, text: str) -> list[int]:
        """Where each unit of a text ends, from one match of all of them."""
        if len(text) <= MATCH_UNITS:
            return self.whole.fullmatch(text).ends(1)
        ends, at = [], 0
        while found := self.part.match(text, at):
            ends += found.ends(1)
            if found.end() == at:
                break
            at = found.end()
        return ends


def transform(
    docs: DataFrame, unit: str = UNIT, seed: int = SEED, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row per row of `docs`: doc_id, text, n (units), form, prefix_chars, middle_chars, output.

    `form` is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). A null text is
    the empty one and stays plain, as do texts that hold a mark. Rows without an id are cut by the draws of an empty
    id, repeated rows alike; texts of any length are cut as a whole; an empty table gives no rows; extra columns are
    ignored. With a `unit` that does not match everywhere, what follows the last unit goes to the suffix.
    """
    rows = texts(docs).withColumns({f"d{i + 1}": d for i, d in enumerate(draws(seed=seed))})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units(unit)
        for batch in batches:
            out, held = [], 0
            for doc_id, text, *d in batch[["doc_id", "text", "d1", "d2", "d3", "d4"]].itertuples(index=False, name=None):
                ends = units.ends(text)
                n = len(ends)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if not text or d[2] % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((doc_id, text, n, "plain", None, None, text))
                else:
                    first, last = sorted((d[0] % (n + 1), d[1] % (n + 1)))
                    a, b = (ends[k - 1] if k else 0 for k in (first, last))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    form = "spm" if d[3] % 100 < suffix_first else "psm"
                    parts = (SUFFIX, suffix, PREFIX, prefix) if form == "spm" else (PREFIX, prefix, SUFFIX, suffix)
                    out.append((doc_id, text, n, form, a, b - a, "".join((*parts, MIDDLE, middle))))
                held += len(text)
                if held > 4 << 20:
                    yield pd.DataFrame(out, columns=COLUMNS).astype(WIDE)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=COLUMNS).astype(WIDE)

    return rows.mapInPandas(cut, SCHEMA)


COLUMNS = ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
WIDE = {"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"}
SCHEMA = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text behind an output: its parts stand between marks that the text itself cannot hold."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.split_part(output, F.lit(second), F.lit(2))
        head = F.substring(F.split_part(output, F.lit(second), F.lit(1)), len(first) + 1, 1 << 30)
        return head, F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(late_prefix, late_middle, late_suffix))
    )
