"""Fill-in-middle against a plain cut by code points."""

from __future__ import annotations

import hashlib

from cases import documents, hard_texts
from pyspark.sql import functions as F

from faultlens.llm import middle as M


def expected(doc_id, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def many():
    odd = ["<", "<S", "S><P", "a<", "<M", "\r\n", "é\u0301", "\U0001f600\U0001f600", "\x00", "x<P>y", "<S>", "..<M>", "<p>", " "]
    return hard_texts() + [(100 + i, odd[i % len(odd)] * (1 + i % 4)) for i in range(200)]


def test_same_as_plain_cut(spark):
    rows = M.transform(documents(spark, many())).withColumn("back", M.restored()).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=str)
    assert got == sorted((expected(i, t) for i, t in many()), key=str)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all(r["back"] == r["text"] for r in rows)


def test_no_rows(spark):
    assert M.transform(documents(spark, hard_texts()).filter("false")).count() == 0


def test_text_longer_than_a_match():
    units = M.Units(M.UNIT)
    text = "aé\n" * (M.MATCH_UNITS // 2)
    assert units.ends(text) == list(range(1, len(text) + 1))
    assert units.ends("ab" * (M.MATCH_UNITS // 2)) == list(range(1, M.MATCH_UNITS + 1))


def test_other_units():
    assert M.Units(r"\X").ends("e\u0301\r\nx") == [2, 4, 5]
    assert M.Units(r"\w+\s*").ends("one two  three!") == [4, 9, 14]
    assert M.Units(r"\d").ends("abc") == []


def test_units_cut_at_their_ends(spark):
    rows = M.transform(documents(spark, [(i, "one two three four five six") for i in range(60)]), unit=r"\w+\s*")
    rows = rows.withColumn("back", M.restored()).filter("form <> 'plain'").collect()
    assert all(r["back"] == r["text"] and r["n"] == 6 for r in rows)
    starts = {0, 4, 8, 14, 19, 24, 27}
    assert {r["prefix_chars"] for r in rows} <= starts and {r["prefix_chars"] + r["middle_chars"] for r in rows} <= starts


def test_draws_are_unsigned(spark):
    row = spark.range(7, 8).select(*[d.alias(f"h{i}") for i, d in enumerate(M.draws(F.col("id")))]).first()
    digest = hashlib.sha256(b"1:7").hexdigest()
    assert list(row) == [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
