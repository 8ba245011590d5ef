"""Packing, near-dedup, LM scoring and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cases import documents, hard_texts, lined, prose
from tokenizers import Tokenizer

from faultlens.llm import common, lm, neardup, packing, queries
from faultlens.llm.common import texts


def check_pieces(rows, pieces, window):
    own = Tokenizer.from_file(queries.TOKENIZER)
    want = sorted((str(i), zlib.crc32(np.asarray(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in rows)
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0) and p.length > 0 and len(p.ids) == 4 * p.length
        at[p.sequence_id] = p.offset + p.length
    assert all(n == window for s, n in at.items() if s != max(at)) and sorted(at) == list(range(len(at)))
    # Repeated rows cannot be told apart, so pieces of an id are compared as a set of starts.
    by_id = {}
    for p in pieces:
        by_id.setdefault(str(p.doc_id), {}).setdefault(p.start, []).append(bytes(p.ids))
    single = [(k, v) for k, v in by_id.items() if all(len(x) == 1 for x in v.values())]
    assert all((k, zlib.crc32(b"".join(v[s][0] for s in sorted(v)))) in want for k, v in single) and len(single) > 8
    return at


@pytest.mark.parametrize("ranks", [None, queries.RANKS])
def test_packing(spark, ranks):
    rows = hard_texts() + [(70, "plain <|endoftext|> text")]
    pieces = packing.pack(documents(spark, rows), queries.TOKENIZER, ranks, window=256).collect()
    check_pieces(rows, pieces, 256)
    assert packing.pack(documents(spark, rows).limit(0), queries.TOKENIZER, ranks).count() == 0


def test_every_window_holds_the_target_mixture(spark):
    rows = [(i, prose(i, 120)) for i in range(60)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS source")
    pieces = packing.pack(docs, queries.TOKENIZER, queries.RANKS, weights={"a": 1.0, "b": 1.0}, window=128).collect()
    check_pieces(rows, pieces, 128)
    total = {s: sum(p.length for p in pieces if p.source == s) for s in "ab"}
    share = {}
    for p in pieces:
        share.setdefault(p.sequence_id, {}).setdefault(p.source, 0)
        share[p.sequence_id][p.source] += p.length
    both = 2 * min(total.values()) // 128
    assert all(abs(share[w]["a"] - 64) <= 1 for w in range(both - 1))  # then the smaller queue is dry
    with pytest.raises(ValueError, match="weight"):
        packing.pack(docs, queries.TOKENIZER, queries.RANKS, weights={"a": 1.0})


def test_shares_are_monotone_and_exact():
    totals = np.array([5, 100_003, 1, 77_777, 0])
    plan = packing.Shares(totals, np.array([0.1, 0.2, 0.3, 0.15, 0.25]), 97)
    n = -(-int(totals.sum()) // 97)
    served = plan.served(np.arange(n + 1))
    assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
    assert (served.sum(axis=1) == np.minimum(np.arange(n + 1) * 97, totals.sum())).all()


def test_near_dedup_finds_the_components(spark):
    rng, rows = random.Random(3), []
    for g in range(6):
        words = prose(200 + g, 300).split()
        for k in range(12):
            w = list(words)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((1000 + 100 * g + k, " ".join(w)))
    rows += hard_texts()
    docs = documents(spark, rows)
    s = neardup.Settings(block_members=3, buckets=1 << 12)
    got = neardup.dedup(docs, s).collect()
    assert len(got) == len(rows)
    idf, known = neardup.word_idf(texts(docs), s.buckets), neardup.WordHashes()
    split = [neardup.split(t or "") for _, t in rows]
    sets = [neardup.shingles(known.of(w), idf, 5) for w in split]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if split[i] == split[j] or neardup.similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    want = {}
    for (i, t), x in zip(rows, label, strict=True):
        want.setdefault(x, []).append((i, t or ""))
    seen = {}
    for r in got:
        seen.setdefault(r["__class_id"], []).append((r.doc_id, r.text or "", r["__kept"]))
    assert sorted(sorted(map(str, v)) for v in want.values()) == sorted(sorted(str(x[:2]) for x in v) for v in seen.values())
    for v in seen.values():
        assert len({x[:2] for x in v if x[2]}) == 1
    assert neardup.dedup(docs.limit(0), s).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    rng, draws = np.random.default_rng(0), neardup._draws()
    h = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    w = rng.uniform(1, 9, 300)
    a, b = (h[:260], w[:260]), (h[40:], w[40:])
    keys = neardup.signatures([a, b], 3000, 1, draws)
    assert abs((keys[0] == keys[1]).mean() - neardup.similarity(a, b)) < 0.03


def test_scores_tell_word_order(spark):
    rng = random.Random(5)
    # A small grammar: every word fixes the next one out of two.
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def speak(seed, n):
        r, w, out = random.Random(seed), "a", []
        for _ in range(n):
            w = r.choice(follow[w])
            out.append(w)
        return out

    train = [(i, " ".join(speak(i, 400))) for i in range(60)]
    s = lm.Settings(masked=0.5)
    docs = texts(documents(spark, train))
    named, counts = lm.vocabulary(docs, s)
    flat = lm.train(lm.tokenize(docs, named, s), counts, s)
    held = [speak(1000 + i, 200) for i in range(20)]
    mixed = [rng.sample(x, len(x)) for x in held]
    rows = [(i, " ".join(x)) for i, x in enumerate(held)] + [(100 + i, " ".join(x)) for i, x in enumerate(mixed)] + [(200, None), (201, "")]
    got = {r.doc_id: r for r in lm.score(lm.tokenize(texts(documents(spark, rows)), named, s), flat, s).collect()}
    right = sum(got[i].mean_log_prob > got[100 + i].mean_log_prob for i in range(20))
    assert right >= 19 and got[200].n_words == 0 and got[201].mean_log_prob is None and got[200].log_prob == 0


def spelled(rows, s):
    """The corpus' words by the contract: (token of a word, count of a word, count of a token)."""
    n = Counter(w for _, t in rows for w in (t or "").encode().split())
    named = {w: i + 1 for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w))[: s.named])}

    def token(w):
        kind = b"U" if w.isupper() else b"T" if w[:1].isupper() else b"l" if w[:1].islower() else b"o"
        return named.get(w) or 1 + s.named + zlib.crc32(kind + w[-2:]) % s.looks

    of_token = Counter()
    for w, k in n.items():
        of_token[token(w)] += k
    return token, n, of_token


def scored(text, flat, s, token, n, of_token):
    """Sum over all words of log P(token | neighbours) + log P(word | token), place by place."""
    v, h, words = s.size, s.hidden, (text or "").encode().split()
    inner, rest = np.split(flat.astype(float), [2 * s.reach * v * h])
    inner, bias, outer, prior = inner.reshape(-1, v, h), rest[:h], rest[h : h + h * v].reshape(h, v), rest[h + h * v :]
    line = [0] * s.reach + [token(w) for w in words] + [0] * s.reach
    total = 0.0
    for i, w in enumerate(words):
        near = line[i : i + s.reach] + line[i + s.reach + 1 : i + 2 * s.reach + 1]
        logits = np.tanh(sum(inner[j][t] for j, t in enumerate(near)) + bias) @ outer + prior
        total += logits[token(w)] - np.log(np.exp(logits).sum())
        total += 0 if 1 <= token(w) <= s.named else np.log(max(n[w], 1) / (of_token[token(w)] + 1))
    return total


def test_scores_are_those_of_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 200)
    s = lm.Settings(named=6, looks=5, hidden=4, masked=0.5)
    shapes = "a A 1 B\u00e9 ABC AbC xY \u2014 \U0001f600 caf\u00e9 CAF\u00c9 9z Z9 zz".split()
    rows = hard_texts() + [(20 + i, " ".join(random.Random(i).choices(shapes, k=60))) for i in range(40)]
    docs = texts(documents(spark, rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # blocks end after a batch
    assert lm.index(docs).select("block").distinct().count() > 3
    known, counts = lm.vocabulary(docs, s)
    tokens = lm.tokenize(docs, known, s)
    flat = lm.train(tokens, counts, s)
    corpus = spelled(rows, s)
    new = [(1, "unseen a wörd A"), (2, rows[0][1])]
    for asked in (rows, new):
        got = lm.score(lm.tokenize(texts(documents(spark, asked)), known, s), flat, s).collect()
        want = sorted((str(i), len((t or "").split()), scored(t, flat, s, *corpus)) for i, t in asked)
        assert len(got) == len(want)
        for r, (i, n, x) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_words, r.log_prob)), want, strict=True):
            assert (str(r.doc_id), r.n_words) == (i, n) and abs(r.log_prob - x) < 1e-4 * (1 + n)
            assert (r.mean_log_prob is None) if n == 0 else abs(r.mean_log_prob - x / n) < 1e-3


def test_scores_tell_documents_that_occur_twice(spark):
    once, twice = [prose(100 + i, 80) for i in range(20)], [prose(200 + i, 80) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(once + twice + twice)] + [(100 + i, "the same old words " * 30) for i in range(40)]
    got = {r.doc_id: r.mean_log_prob for r in lm.train_and_score(documents(spark, rows)).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, 60))


@pytest.mark.parametrize("masked", [0.15, 0.5, 1.0])
def test_every_place_is_a_target(spark, monkeypatch, masked):
    places = []

    def stored(df, label):
        df = common.store(df, label)
        if label == "lm-round":
            places.append(df.selectExpr("sum(places)").first()[0])
        return df

    s = lm.Settings(named=6, looks=5, hidden=4, masked=masked, rounds=1)
    docs = texts(documents(spark, hard_texts()))
    known, counts = lm.vocabulary(docs, s)
    tokens = common.store(lm.tokenize(docs, known, s), "test")
    monkeypatch.setattr(lm, "store", stored)
    lm.train(tokens, counts, s)
    assert sum(places) == counts.sum() == sum(len((t or "").split()) for _, t in hard_texts())
    assert all(abs(n / counts.sum() - masked) < 0.05 for n in places[: int(1 / masked)])


def test_gradient():
    s = lm.Settings(named=5, looks=3, hidden=4)
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, len(lm.Network.start(s, np.ones(s.size))))
    context, target = rng.integers(0, s.size, (4, 6)), rng.integers(0, s.size, 6)
    loss = lambda f: -lm.Network(s, f).log_probs(context, target).mean(dtype=np.float64)
    grad = lm.Network(s, flat).gradient(context, target)
    for i in rng.choice(len(flat), 40):
        step = np.zeros(len(flat))
        step[i] = 1e-2
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-2 - grad[i]) < 2e-3


def test_scoring_of_an_empty_table(spark):
    assert lm.train_and_score(documents(spark, []).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    good = [(i, lined(300 + i, 30, 5)) for i in range(12)]
    passage = prose(400, 20)
    rows = good + [
        (20, good[0][1]),  # an exact copy: its lines go
        (21, " ".join(["junk"] * 300)),
        (22, lined(500, 30, 3) + "\n" + passage),
        (23, None),
        (24, good[1][1].replace(" ", "  ")),
        (25, lined(600, 40, 3)),
        (26, lined(600, 40, 3).replace("\n", " ")),  # near once line breaks do not count
    ]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(12), 25}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "benchmark decontamination", "packing"]
    # Nulls in any column, repeated rows and long texts pass through every stage.
    hard = documents(spark, hard_texts()).select("doc_id", "text", "lang", "source", "n_chars")
    hard = hard.unionByName(hard.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS LONG) AS n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, hard, str(tmp_path)).collect()
        assert stage(spark, hard.limit(0), str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
