"""The filter audit against a plain run of all chains."""

from __future__ import annotations

import random
import re
from itertools import permutations
from math import factorial

from cases import documents, hard_texts

from faultlens.llm import interactions as I

LABELS = "doc_id long, quality int, toxic int, part string, mask string, own string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], LABELS)


def fails(docs):
    """Letters that each (id, text) row fails."""
    out = []
    for doc_id, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o in docs)
        upper = len(re.findall("[A-Z]", t))
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)
        out.append({f for f, x in zip("ABCDE", tests, strict=True) if x})
    return out


def chains(docs, parts, marks):
    """One row per part, order and step, by running every chain over every document."""
    failed = fails(docs)
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    out = []
    for part in sorted(set(parts)):
        rows = [(i, f) for (i, _), f, p in zip(docs, failed, parts, strict=True) if p == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                steps.append(
                    ("".join(order), step, len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                     sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), f)
                )
        out += [(part, *s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = [chr(97 + i) * 3 for i in range(26)] + ["Upper", "CAPS", "tag#", "a|b", "ü"]
    made = [(30 + i, " ".join(rng.choices(words[: rng.choice((5, 26, 31))], k=rng.choice((3, 150, 230))))) for i in range(60)]
    return hard_texts() + made + [(200 + i, made[i % 7][1]) for i in range(20)]


def test_same_as_running_every_chain(spark):
    docs = texts()
    frame = documents(spark, docs).drop("lang").withColumnsRenamed({"h1": "lang"})
    parts = [None if i is None else ("en", "fr", None)[i % 3] for i, _ in docs]
    from pyspark.sql import functions as F

    frame = frame.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr"))
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(30, 90)] + [(33, 1, 1), (34, None, None), (None, 1, 1), (35, 0, 1), (35, 1, 0), (9999, 1, 1)]
    got = sorted(tuple(r) for r in I.audit(frame, labels(spark, marks)).collect())
    assert got == chains(docs, [p or "" for p in parts], marks)
    assert len(got) == 3 * 120 * 5


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    from faultlens.llm import common

    docs, marks = documents(spark, texts()), labels(spark, [(i, 1, i % 2) for i in range(40)])
    few = sorted(tuple(r) for r in I.audit(docs, marks).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in I.audit(docs, marks).collect()) == few


def test_no_documents_and_no_labels(spark):
    docs, none = documents(spark, texts()), labels(spark, [(1, 1, 1)]).filter("false")
    assert I.audit(docs.filter("false"), none).count() == 0
    rows = I.audit(docs, none).collect()
    assert len(rows) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


def test_swaps_meet_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), []
        for k in I.orders_by_swaps(n):
            if k is not None:
                order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == factorial(n)


def test_a_swapped_diagram_equals_a_new_one():
    rng = random.Random(9)
    counts = {rng.randrange(32): (rng.randint(1, 9), rng.randint(0, 3), 0) for _ in range(12)}
    diagram = I.Diagram(counts, 5)
    for k in I.orders_by_swaps(5):
        if k is not None:
            diagram.swap(k)
        moved = {sum(1 << i for i, f in enumerate(diagram.order) if mask >> f & 1): c for mask, c in counts.items()}
        anew = I.Diagram(moved, 5)
        assert diagram.steps() == anew.steps()
        assert [len(level) for level in diagram.levels] == [len(level) for level in anew.levels]
