"""Log templates by similarity, whatever the order of lines.

A leaf holds the distinct masked signatures of a case with the same number of tokens and the same first token. Inside
of a leaf, signatures whose tokens agree at a share of `similarity` of the places become one template; places at which
its members differ turn into wildcards, which agree with nothing. Templates are clustered like signatures until no two
of a leaf are similar any more:

* first, signatures that agree in a whole stretch of the needed length (at their head, middle or tail) are linked
  through the stretch itself, a grouping without pairs;
* then all similar pairs of what is left are found, by an exact join on tokens at places: of a template with k tokens,
  two of which any similar template must share s, the k - s + 1 rarest are enough, so tokens that every line has bring
  no lines together;
* linked templates are contracted by components, and the second step starts anew.

Nothing is done per leaf in one task: leaves are columns of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import text
from faultlens.plans.components import components
from faultlens.plans.materialize import materialize

LEAF = ["case_id", "width", "head"]
KEY = [*LEAF, "place", "word"]


def with_leaf(signatures: DataFrame) -> DataFrame:
    """Add `tokens` and the leaf of each signature; a first token with a digit is a wildcard head."""
    tokens = F.split("signature", " ")
    first = F.get(tokens, F.lit(0))
    head = F.when(first.rlike(r"(?U)\d"), F.lit(K.WILDCARD)).otherwise(first)
    return signatures.withColumns({"tokens": tokens, "width": F.size(tokens), "head": head})


def _node(signature: Column) -> Column:
    return F.md5(F.concat_ws("\n", F.col("case_id"), signature).cast("binary"))


def nodes(signatures: DataFrame) -> DataFrame:
    """(leaf, signature, tokens, node) of distinct (case_id, signature)."""
    return with_leaf(signatures.select("case_id", "signature").distinct()).withColumn("node", _node(F.col("signature")))


def needed(width: Column, similarity: float) -> Column:
    """Least number of equal places that makes a share of `similarity`."""
    return F.greatest(F.lit(1), F.ceil(width * F.lit(similarity) - F.lit(1e-9))).cast("int")


def equal_places(a: str | Column, b: str | Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != K.WILDCARD), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x)


def _fixed(df: DataFrame) -> DataFrame:
    """A row per place of `tokens` that is no wildcard."""
    return df.select(*LEAF, "node", F.posexplode("tokens").alias("place", "word")).filter(F.col("word") != K.WILDCARD)


def stretch_links(found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes that agree in all needed places at the head, in the middle or at the tail."""
    need = needed(F.col("width"), similarity)
    starts = F.array(F.lit(1), F.floor((F.col("width") - need) / 2).cast("int") + 1, F.col("width") - need + 1)
    stretches = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("tokens", s, need).alias("words")))
    whole = F.filter(stretches, lambda s: ~F.array_contains(s["words"], K.WILDCARD))
    keyed = found.select(*LEAF, "node", F.explode(whole).alias("s")).select(
        *LEAF, "node", F.col("s.at").alias("place"), F.md5(F.array_join("s.words", " ").cast("binary")).alias("word")
    )
    keyed = materialize(keyed, "stretches")
    least = keyed.groupBy(*KEY).agg(F.min("node").alias("b"), F.max("node").alias("hi")).filter("b < hi").drop("hi")
    return keyed.join(materialize(least, "stretch-keys"), KEY).filter("node > b").select(F.col("node").alias("a"), "b").distinct()


def similar_links(found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of all pairs of a leaf that are similar."""
    need = needed(F.col("width"), similarity)
    found = found.withColumn("need", need).withColumn("fixed", F.size(F.filter("tokens", lambda w: w != K.WILDCARD)))
    found = found.filter("fixed >= need")
    keys = materialize(_fixed(found), "places")
    counts = materialize(keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "place-counts")
    ranked = keys.join(counts, KEY).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "place", "word"))).alias("k"))
    rare = found.join(ranked, "node").select(
        *LEAF, "node", F.explode(F.slice("k", F.lit(1), F.col("fixed") - F.col("need") + 1)).alias("k")
    )
    rare = materialize(rare.filter("k.n > 1").select(*LEAF, "node", "k.place", "k.word"), "rare-places")
    other = rare.withColumnRenamed("node", "b")
    pairs = rare.withColumnRenamed("node", "a").join(other, KEY).filter("a > b").select("a", "b").distinct()
    side = lambda n: found.select(F.col("node").alias(n), F.col("tokens").alias(f"tokens_{n}"), F.col("need").alias(f"need_{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.filter(equal_places("tokens_a", "tokens_b") >= F.col("need_a")).select("a", "b")


def contract(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(old, leaf, tokens, node): every node with the template of its component, differing places as wildcards."""
    grouped = materialize(found.join(roots, "node").select("root", "node", *LEAF, "tokens"), "grouped")
    words = grouped.select("root", F.posexplode("tokens").alias("place", "word"))
    agreed = words.groupBy("root", "place").agg(F.min("word").alias("lo"), F.max("word").alias("hi"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(K.WILDCARD))
    merged = agreed.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("place", word.alias("w")))).alias("p"))
    merged = merged.select("root", F.transform("p", lambda x: x["w"]).alias("tokens"))
    joined = grouped.drop("tokens").join(materialize(merged, "merged"), "root").withColumnRenamed("node", "old")
    changed = joined.withColumn("node", _node(F.array_join("tokens", " "))).select("old", *LEAF, "tokens", "node")
    alone = found.join(roots, "node", "left_anti").select(F.col("node").alias("old"), *LEAF, "tokens", "node")
    return changed.unionByName(alone)


def cluster(found: DataFrame, similarity: float = K.TEMPLATE_SIMILARITY) -> DataFrame:
    """(first, leaf, tokens, node): the template that each node of `found` (leaf, tokens, node) ends up in."""
    now = materialize(found.select(F.col("node").alias("first"), *LEAF, "tokens", "node"), "clusters")
    link = stretch_links
    while True:
        each = now.select(*LEAF, "tokens", "node").dropDuplicates(["node"])
        links = materialize(link(each, similarity), "similar")
        if not links.isEmpty():
            moved = contract(each, components(links)).withColumnRenamed("node", "__node")
            now = now.select("first", F.col("node").alias("old")).join(moved, "old").drop("old").withColumnRenamed("__node", "node")
            now = materialize(now, "clusters")
        elif link is similar_links:
            return now
        link = similar_links


def _signed(lines: DataFrame, phase: str) -> DataFrame:
    return lines.filter(F.col("phase") == phase).withColumn("signature", text.signature(F.col("line")))


def baseline_templates(lines: DataFrame, similarity: float = K.TEMPLATE_SIMILARITY) -> DataFrame:
    """(leaf, tokens, node, template, signatures) of the baseline lines per case."""
    clustered = cluster(nodes(_signed(lines, "baseline").filter("signature <> ''")), similarity)
    found = clustered.groupBy(*LEAF, "node").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("signatures"))
    return found.withColumn("template", F.array_join("tokens", " "))


def mine_templates(lines: DataFrame, similarity: float = K.TEMPLATE_SIMILARITY) -> DataFrame:
    """Templates of the baseline lines per case, with the number of distinct signatures behind each."""
    return baseline_templates(lines, similarity).select("case_id", "template", "signatures")


def fitting(signatures: DataFrame, templates: DataFrame) -> DataFrame:
    """(node, template): signatures that a template covers as it is; of several the one with most words, then the least.

    A template is looked up by the rarest of its words; one of wildcards only covers its whole leaf.
    """
    places = _fixed(templates)
    counts = places.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    anchors = places.join(counts, KEY).groupBy("node").agg(F.min(F.struct("n", "place", "word")).alias("k"))
    anchors = templates.join(anchors, "node", "left").select(
        *LEAF, F.coalesce("k.place", F.lit(-1)).alias("place"), F.coalesce("k.word", F.lit("")).alias("word"), "template", F.col("tokens").alias("known")
    )
    any_word = F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("word")))
    own = F.transform("tokens", lambda w, i: F.struct(i.alias("place"), w.alias("word")))
    asked = signatures.select(*LEAF, "node", "tokens", F.explode(F.concat(any_word, own)).alias("k")).select(*LEAF, "node", "tokens", "k.*")
    covers = F.forall(F.zip_with("known", "tokens", lambda t, w: (t == K.WILDCARD) | (t == w)), lambda x: x)
    words = F.size(F.filter("known", lambda w: w != K.WILDCARD))
    met = asked.join(materialize(anchors, "anchors"), KEY).filter(covers)
    return met.groupBy("node").agg(F.min_by("template", F.struct(-words, "template")).alias("template"))


def classify_lines(lines: DataFrame, similarity: float = K.TEMPLATE_SIMILARITY) -> DataFrame:
    """Incident lines with template and novelty: novel is a template that the baseline lacks.

    A line that a baseline template covers belongs to it. All others are clustered along with the baseline templates:
    one that is similar to a template widens it, which makes a new template of it, as does one that starts its own.
    A blank line has an empty template, never novel.
    """
    incident = _signed(lines, "incident")
    base = materialize(baseline_templates(lines, similarity), "baseline-templates")
    asked = materialize(nodes(incident.filter("signature <> ''")), "incident-signatures")
    covered = materialize(fitting(asked, base), "covered")
    rest = asked.join(covered, "node", "left_anti").select(*LEAF, "tokens", "node")
    widened = cluster(base.select(*LEAF, "tokens", "node").unionByName(rest).dropDuplicates(["node"]), similarity)
    widened = widened.select(F.col("first").alias("node"), F.array_join("tokens", " ").alias("template"))
    named = covered.unionByName(rest.select("node").join(widened, "node"))
    known = base.select("case_id", "template", F.lit(True).alias("__known"))
    named = asked.select("case_id", "signature", "node").join(named, "node").join(known, ["case_id", "template"], "left")
    named = materialize(named.select("case_id", "signature", "template", F.col("__known").isNull().alias("is_novel")), "named")
    judged = incident.join(named, ["case_id", "signature"], "left")
    return judged.select(
        *lines.columns, F.coalesce("template", F.lit("")).alias("template"), F.coalesce("is_novel", F.lit(False)).alias("is_novel")
    )
