"""Line dedup against brute force."""

from __future__ import annotations

from cases import documents, hard_texts, lined, prose
from pyspark.sql import functions as F

from faultlens.llm import lines
from faultlens.llm.common import texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    placed = sorted(
        ((-(1 << 63) if i is None else i, h, k, [w for w in l.translate(str.maketrans("\t\v\f\r", "    ")).split(" ") if w]) for (i, t, h) in rows if t is not None for k, l in enumerate(t.split("\n"))),
        key=lambda x: x[:3],
    )
    placed = [p for p in placed if len(p[3]) >= lines.MIN_WORDS]
    gone = set()
    for n, p in enumerate(placed):
        for q in placed[:n]:
            if q[:3] == p[:3]:
                continue
            near = min(len(p[3]), len(q[3])) >= lines.MIN_WORDS_NEAR and abs(len(p[3]) - len(q[3])) < 2
            if p[3] == q[3] or near and distance(p[3], q[3]) <= 1:
                gone.add(p[:3])
                break
    return sorted(((i, None if t is None else "\n".join(l for k, l in enumerate(t.split("\n")) if (-(1 << 63) if i is None else i, h, k) not in gone)) for i, t, h in rows), key=str)


def with_hashes(df):
    from faultlens.llm.common import text_hash

    return [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", text_hash().alias("h")).collect()]


def test_lines_within_one_word(spark):
    base = prose(1, 14).split()
    changed = [base[:3] + ["new"] + base[4:], base[1:], base[:-1], base + ["new"], base[:7] + ["a", "b"] + base[7:], base[:2] + ["x"] + base[3:9] + ["y"] + base[10:]]
    rows = hard_texts() + [(100, " ".join(base))] + [(101 + k, prose(50 + k, 12) + "\n" + " ".join(w)) for k, w in enumerate(changed)]
    rows += [(120, "a b c d"), (121, "a b c e"), (122, "a b c d"), (123, "a b"), (124, "a b"), (130, lined(7, 11, 6)), (131, lined(7, 11, 6))]
    docs = documents(spark, rows)
    got = lines.dedup(docs)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(with_hashes(docs))


def test_repeated_lines_of_one_or_two_words(spark):
    docs = documents(spark, [(1, "one\n\nof two\n  \none"), (2, "\nof  two\nother\n"), (3, "one two\n  ")])
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert got == {1: "one\n\nof two\n  ", 2: "\nother\n", 3: "one two\n  "}


def test_edit_check(spark):
    words = [["a", "b", "c"], ["a", "c"], ["a", "x", "c"], ["b", "c"], ["a", "b", "c", "d"], ["x", "b", "y"], ["c", "b", "a"]]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a array<string>, b array<string>")
    for r in pairs.select("a", "b", lines.within_one_edit(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= 1), (r.a, r.b)


def test_empty_table_and_plan(spark):
    none = documents(spark, []).limit(0)
    assert lines.dedup(none).count() == 0
    plan = lines.dedup(documents(spark, [(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert texts(none).count() == 0


def test_the_same_without_broadcasts(spark, monkeypatch):
    """Beyond the size limit joins shuffle both sides."""
    from faultlens.llm import common, decontam

    rows = hard_texts() + [(130, lined(7, 11, 6)), (131, lined(7, 11, 6)), (132, prose(9, 15))]
    docs, bench = documents(spark, rows), spark.createDataFrame([(1, prose(9, 15))], "item_id long, text string")
    shown = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = shown(lines.dedup(docs)), shown(decontam.clean(docs, bench))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert (shown(lines.dedup(docs)), shown(decontam.clean(docs, bench))) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
