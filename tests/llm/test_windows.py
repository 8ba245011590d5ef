"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, hard_texts, prose

from faultlens.llm import anchors, substring, suffix


def spans_of(flags):
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0]))
    return [tuple(x) for x in edge.reshape(-1, 2).tolist()]


def brute_words(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram"), [(50, 10), (8, 3)])
def test_substring_dedup(spark, window, gram):
    rows = hard_texts()
    got = substring.dedup(documents(spark, rows), window, gram).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_words(rows, window)


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        out.append((i, len(b), spans_of(gone), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [suffix.BLOCK_BYTES, 2000])
def test_suffix_dedup(spark, block_bytes):
    rows = [r for r in hard_texts() if r[0] != 8] + [(20, prose(3, 70)[:450] + prose(9, 40)), (21, prose(8, 90) + prose(3, 70)[:450])]
    got = suffix.dedup(documents(spark, rows), block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_bytes, [(s.first, s.end) for s in r.removed], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(got, key=str) == brute_bytes(rows, 400)


def test_many_contexts_of_one_passage_fill_several_blocks(spark):
    passage = prose(30, 90)
    rows = [(i, prose(100 + i, 30) + passage + prose(200 + i, 30)) for i in range(40)]
    got = suffix.dedup(documents(spark, rows), block_bytes=3000).collect()
    got = [(r.doc_id, r.n_bytes, [(s.first, s.end) for s in r.removed], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(got, key=str) == brute_bytes(rows, 400)


def test_classes_are_those_of_common_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 600).astype(np.int16)
    text[300:400] = text[100:200]
    text[[250, 599]] = 0
    order, classes = suffix.common_prefix_classes(text, 12)
    first = {}
    for i, c in zip(order, classes, strict=True):
        part = tuple(text[i : i + 12])
        if len(part) == 12 and 0 not in part:
            assert first.setdefault(part, c) == c
    assert len(set(first.values())) == len(first)


def test_runs_cover_every_window_once_and_stretches_join(monkeypatch):
    values = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    for stretch in (1 << 20, 257):
        monkeypatch.setattr(anchors, "STRETCH", stretch)
        covered = [i for _, _, first, n, _ in anchors.runs(values, 20, 5) for a, m in zip(first, n, strict=True) for i in range(a, a + m)]
        assert covered == list(range(len(values) - 19))


def test_empty_table(spark):
    none = documents(spark, []).limit(0)
    assert substring.dedup(none).count() == 0
    assert suffix.dedup(none).count() == 0
