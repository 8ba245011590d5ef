"""Small tables that hold what operators must bear: nulls, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, words string, h1 string, node string, row_id string, "
    "spans string, line string, n string, seed string, anchor string"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def lined(seed: int, n: int, lines: int) -> str:
    return "\n".join(prose(seed * 100 + i, n) for i in range(lines))


def documents(spark, texts):
    """(id, text) pairs as a documents table whose other columns carry the names that operators use inside."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), *["x"] * 9) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def hard_texts():
    a, b = prose(1, 400), prose(2, 300)
    passage = prose(3, 70)
    return [
        (1, a),
        (2, None),
        (3, ""),
        (4, " \n\t \n"),
        (5, a),
        (6, b + " " + passage + " " + prose(4, 80)),
        (7, prose(5, 60) + "\n" + passage + "\n" + prose(6, 20)),
        (7, prose(5, 60) + "\n" + passage + "\n" + prose(6, 20)),
        (8, prose(7, 20_000)),
        (9, "word " * 3000),
        (10, "ünï çödé — \U0001f600 " * 40 + passage),
        (11, "x" * 5000),
        (None, a),
        (None, None),
        (12, passage),
        (13, "\n".join(["same line here again"] * 5)),
        (14, passage.replace(" ", "  ", 1)),
    ]
