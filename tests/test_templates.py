from __future__ import annotations

import random
import re
from math import ceil

import pytest

from faultlens.operators import templates as T
from faultlens.plans.components import components

WILD = "<*>"


def frame(spark, baseline, incident):
    rows = [("c", "baseline", "s", i, float(i), x) for i, x in enumerate(baseline)]
    rows += [("c", "incident", "s", i, 1e6 + i, x) for i, x in enumerate(incident)]
    return spark.createDataFrame(rows, "case_id string, phase string, service string, line_no long, ts double, line string")


def rounds_of(signatures, similarity=0.4):
    """{signature: template} by comparing every pair of a leaf in each round."""
    now = {s: s for s in signatures}

    def leaf(w):
        return len(w), WILD if re.search(r"\d", w[0]) else w[0]

    def near(a, b, first):
        need = max(1, ceil(similarity * len(a) - 1e-9))
        if not first:
            return sum(x == y != WILD for x, y in zip(a, b, strict=True)) >= need
        starts = (0, (len(a) - need) // 2, len(a) - need)
        return any(a[s : s + need] == b[s : s + need] and WILD not in a[s : s + need] for s in starts)

    first = True
    while True:
        groups = {t: {t} for t in set(now.values())}
        words = {t: t.split(" ") for t in groups}
        merged = False
        for a in words:
            for b in words:
                if a < b and leaf(words[a]) == leaf(words[b]) and groups[a] is not groups[b] and near(words[a], words[b], first):
                    groups[a] |= groups[b]
                    for t in groups[b]:
                        groups[t] = groups[a]
                    merged = True
        if not merged and not first:
            return now
        first = False
        name = {t: " ".join(x[0] if len(set(x)) == 1 else WILD for x in zip(*(words[m] for m in g), strict=True)) for t, g in groups.items()}
        now = {s: name[t] for s, t in now.items()}


BASE = ["user alice logged in", "user bob logged in", "user alice logged in", "job done fine", "7 items left", "9 items lost"]


def test_known_and_novel(spark):
    lines = ["user carol logged in", "user carol logged out", "disk exploded badly here today", "", "8 items kept", "job done fine"]
    got = {r.line_no: (r.template, r.is_novel) for r in T.classify_lines(frame(spark, BASE, lines)).collect()}
    assert got[0] == ("user <*> logged in", False)
    # Similar to a template, but not covered by it: the template widens, which makes it a new one.
    assert got[1] == ("user <*> logged <*>", True)
    assert got[2] == ("disk exploded badly here today", True)
    assert got[3] == ("", False)
    assert got[4] == ("<<NUM>> items <*>", False) and got[5] == ("job done fine", False)


def test_order_does_not_matter(spark):
    want = {(r.template, r.signatures) for r in T.mine_templates(frame(spark, BASE, [])).collect()}
    assert want == {(r.template, r.signatures) for r in T.mine_templates(frame(spark, BASE[::-1], [])).collect()}
    assert ("user <*> logged in", 2) in want and ("job done fine", 1) in want


def test_under_the_share_apart_above_it_together(spark):
    base = ["put a b c d", "put a x y z", "get a b c d", "get q r s t", "run a b c d", "run e f g d", "run e h i j"]
    names = {r.template for r in T.mine_templates(frame(spark, base, [])).collect()}
    # 2 of 5 places are enough, 1 is not; what has become a wildcard is no longer equal to anything.
    assert names == {"put a <*> <*> <*>", "get a b c d", "get q r s t", "run e <*> <*> <*>", "run a b c d"}
    strict = {r.template for r in T.mine_templates(frame(spark, base, []), 0.6).collect()}
    assert strict == set(base)


def made_signatures(seed, leaves, count, places=(2, 9), words=6):
    rng = random.Random(seed)
    out = set()
    for _ in range(count):
        width = rng.randint(*places)
        out.add(" ".join([f"h{'abc'[rng.randrange(leaves)]}", *(rng.choice("uvwxyz"[:words]) + chr(97 + p) for p in range(width - 1))]))
    return sorted(out)


@pytest.mark.parametrize("seed,words", [(2, 3)])
def test_same_as_all_pairs(spark, seed, words):
    rng = random.Random(seed)
    base = made_signatures(seed, 3, 60, words=words) + [f"{i}x {rng.choice('abc')} {rng.choice('de')} k{i}y" for i in range(12)]
    more = made_signatures(seed + 100, 3, 30, words=words)
    want = rounds_of(base)
    mined = {r.template: r.signatures for r in T.mine_templates(frame(spark, base, [])).collect()}
    assert mined == {t: list(want.values()).count(t) for t in set(want.values())}

    got = {r.line: (r.template, r.is_novel) for r in T.classify_lines(frame(spark, base, more)).collect()}
    known = set(want.values())

    def covering(s):
        w = s.split(" ")
        fits = [t for t in known if len(t.split(" ")) == len(w) and all(x in (WILD, y) for x, y in zip(t.split(" "), w, strict=True))]
        return min(fits, key=lambda t: (t.split(" ").count(WILD), t), default=None)

    covered = {s: covering(s) for s in more}
    wide = rounds_of(known | {s for s in more if covered[s] is None})
    for s in more:
        template = covered[s] or wide[s]
        assert got[s] == (template, template not in known), s


def test_one_common_word_links_no_pairs(spark):
    """A leaf whose lines share a word and nothing else stays as it is, and its pairs are never made."""
    lines = [f"same k{i}a l{i}b m{i}c n{i}d o{i}e" for i in range(3000)]
    found = T.nodes(spark.createDataFrame([("c", x) for x in lines], "case_id string, signature string"))
    assert T.similar_links(found, 0.4).count() == 0
    assert T.cluster(found.drop("signature")).select("node").distinct().count() == 3000


def test_long_line(spark):
    base = ["w" + " x" * 20_000 + " end", "w" + " x" * 20_000 + " other"]
    assert [r.signatures for r in T.mine_templates(frame(spark, base, [])).collect()] == [2]


def test_no_lines(spark):
    assert T.classify_lines(frame(spark, BASE, [])).count() == 0
    assert T.mine_templates(frame(spark, [], ["a b"])).count() == 0
    got = T.classify_lines(frame(spark, [], ["a b", "a c d"])).collect()
    assert {(r.template, r.is_novel) for r in got} == {("a b", True), ("a c d", True)}


def roots_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("s", f"s{i:03}") for i in range(50)]
    loose = [(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(60)]
    pairs = chain + star + loose + [("x", "x"), ("c005", "c001")]
    rng.shuffle(pairs)
    links = spark.createDataFrame(sorted({(max(p), min(p)) for p in pairs if p[0] != p[1]}), "a string, b string")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: v for k, v in roots_of(p for p in pairs if p[0] != p[1]).items()}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
