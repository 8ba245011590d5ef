"""License scans: passages whose word bigrams agree with those of a licence template by Dice's coefficient.

Passages are the lines of a text and its paragraphs of several lines. The coefficient of two sets can only reach the
threshold if their sizes are close, so a passage meets only the templates within its size bounds. A notice that is part
of a longer paragraph is found by windows as long as the template.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.common import store, text_hash, texts
from faultlens.llm.decontam import plain_words

# Public licence notices, as they are commonly written.
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
MIN_DICE = 0.8


def _pairs(words: Column, pair) -> Column:
    """What `pair` makes of every pair of neighbouring words, by its place."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)
    return F.when(F.size(words) > 1, pairs)


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def templates(spark: SparkSession, texts_by_license: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(license, template, words, size, bigram) of all templates; as large as the list that the caller states."""
    rows = [(name, i, text) for name, several in texts_by_license.items() for i, text in enumerate(several)]
    listed = spark.createDataFrame(rows, "license string, template int, text string").withColumn("words", plain_words("text"))
    listed = listed.withColumn("bigrams", F.array_distinct(_pairs(F.col("words"), lambda i: _hash(F.col("words"), i))))
    return listed.select("license", "template", F.size("words").alias("words"), F.size("bigrams").alias("size"), F.explode("bigrams").alias("bigram"))


def passages(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line, lines, block, pairs): every line, and every paragraph of several lines, by its first line.

    `pairs` are the places and hashes of neighbouring words and the lines they begin and end in; `block` marks what no
    other passage holds. A line without a letter or digit ends a paragraph.
    """
    rows = texts(docs, *[k for k in keep if k not in ("doc_id", "text_hash")]).withColumn("text_hash", text_hash()).withColumn("all", F.transform(F.split("text", "\n"), plain_words))
    # Ends of paragraphs: places of lines without words, and the end of the text.
    breaks = F.concat(F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.size(F.get("all", i)) == 0), F.array(F.size("all")))
    rows = rows.withColumn("breaks", breaks)
    begin = lambda k: F.coalesce(F.get("breaks", k - 1) + 1, F.lit(0))
    blocks = F.transform("breaks", lambda end, k: F.struct(begin(k).alias("line"), (end - begin(k)).alias("lines"), F.lit(True).alias("block")))
    blocks = F.filter(blocks, lambda b: b["lines"] > 0)
    inner = F.transform(
        F.flatten(F.transform(F.filter(blocks, lambda b: b["lines"] > 1), lambda b: F.sequence(b["line"], b["line"] + b["lines"] - 1))),
        lambda i: F.struct(i.alias("line"), F.lit(1).alias("lines"), F.lit(False).alias("block")),
    )
    own = lambda p: F.slice("all", p["line"] + 1, p["lines"])
    full = F.transform(
        F.concat(blocks, inner),
        lambda p: F.struct(
            p["line"].alias("line"),
            p["lines"].alias("lines"),
            p["block"].alias("block"),
            F.flatten(own(p)).alias("words"),
            F.flatten(F.transform(own(p), lambda w, k: F.array_repeat(p["line"] + k, F.size(w)))).alias("owner"),
        ),
    )
    rows = rows.select(*keep, F.explode_outer(full).alias("p")).select(*keep, "p.*")
    words, owner = F.col("words"), F.col("owner")
    pair = lambda i: F.struct(i.alias("at"), _hash(words, i).alias("bigram"), F.get(owner, i).alias("first"), F.get(owner, i + 1).alias("last"))
    return rows.select(*keep, "line", "lines", "block", _pairs(words, pair).alias("pairs"))


#: A pair of words that a template has too; `n`: distinct pairs of its passage, null where it counts for windows.
_MET = "array<struct<n:int,bigram:bigint,at:int,first:int,last:int>>"


def _windows(hits: Column, words: Column, size: Column, min_dice: float) -> Column:
    """Windows of a template's length over the sorted hits of a paragraph that reach the threshold.

    A window begins and ends with a hit. Its pairs that the template lacks count by place.
    """

    def window(h: Column, k: Column) -> Column:
        inside = F.filter(F.slice(hits, k + 1, words), lambda x: x["at"] < h["at"] + words - 1)
        return F.struct(h["at"].alias("at"), h["first"].alias("first"), F.size(inside).alias("hits"), F.element_at(inside, -1).alias("end"), F.size(F.array_distinct(F.transform(inside, lambda x: x["bigram"]))).alias("common"))

    def rated(w: Column) -> Column:
        n = w["end"]["at"] - w["at"] + 1 - w["hits"] + w["common"]
        dice = F.round(2 * w["common"] / (n + size), 6)
        return F.struct((-dice).alias("less"), (-size).alias("shorter"), w["at"].alias("at"), w["end"]["at"].alias("until"), w["first"].alias("line"), (w["end"]["last"] - w["first"] + 1).alias("lines"))

    return F.filter(F.transform(F.transform(hits, window), rated), lambda w: -w["less"] >= min_dice)


def _apart(windows: Column) -> Column:
    """Of sorted windows those that overlap none before them that stays."""
    none = F.filter(windows, lambda w: F.lit(False))
    meets = lambda a, b: (a["at"] <= b["until"]) & (b["at"] <= a["until"])
    return F.aggregate(windows, none, lambda kept, w: F.when(F.exists(kept, lambda k: meets(k, w)), kept).otherwise(F.array_append(kept, w)))


def scan(docs: DataFrame, known: dict[str, tuple[str, ...]] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, line, lines, license, dice): the best licence of every passage that reaches the threshold.

    Of equal coefficients the licence that comes first by name counts. Notices inside of longer passages follow with
    the lines they stand on, best first where they overlap, unless these lines lie in a passage that is listed. A
    passage of fewer than two words, a null or an empty text gives nothing; rows that agree in all they show give the
    same rows once; extra columns are ignored.
    """
    spark = docs.sparkSession
    listed = store(templates(spark, known), "licenses-templates")
    sizes, pairs = zip(*[(r["size"], r["bigram"]) for r in listed.select("size", "bigram").distinct().collect()] or [(0, 0)], strict=True)
    smallest, largest = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    found = passages(docs, "doc_id", "text_hash")
    # What no template has is left out before the explode; its number counts.
    distinct = F.size(F.array_distinct(F.transform("pairs", lambda p: p["bigram"])))
    hits = F.filter("pairs", lambda p: p["bigram"].isin(list(set(pairs))))
    key = ["doc_id", "text_hash", "line", "lines"]
    found = found.select(*key, "block", distinct.alias("n"), hits.alias("hits"))
    # A window has `smallest` of its template's pairs at least, and as much of its own, so somewhere `run` of them are close.
    run = max(1, math.ceil(smallest * min(sizes)))
    close = lambda h, k: F.get("hits", k + run - 1)["at"] - h["at"] < 2 * run / smallest
    dense = F.col("block") & F.exists(F.transform("hits", close), lambda c: F.coalesce(c, F.lit(False)))
    cut = lambda n: lambda h: F.struct(n.alias("n"), h["bigram"].alias("bigram"), h["at"].alias("at"), h["first"].alias("first"), h["last"].alias("last"))
    empty = F.array().cast(_MET)
    whole = F.when((F.col("n") <= max(sizes) * largest) & (F.size("hits") >= run), F.transform("hits", cut(F.col("n")))).otherwise(empty)
    parts = F.when(dense, F.transform("hits", cut(F.lit(None).cast("int")))).otherwise(empty)
    found = found.select(*key, F.explode_outer(F.concat(whole, parts)).alias("b")).select(*key, "b.*")
    met = store(found.join(F.broadcast(listed), "bigram"), "licenses-met")

    fits = (F.col("n") >= smallest * F.col("size")) & (F.col("n") <= largest * F.col("size"))
    best = met.filter("n IS NOT NULL").filter(fits).groupBy(*key, "n", "license", "template", "size").agg(F.count_distinct("bigram").alias("common"))
    best = best.withColumn("dice", F.round(2 * F.col("common") / (F.col("n") + F.col("size")), 6)).filter(F.col("dice") >= min_dice)
    best = best.groupBy(*key).agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    best = store(best, "licenses-passages")

    part = met.filter("n IS NULL").groupBy(*key, "license", "template", "words", "size").agg(
        F.sort_array(F.collect_set(F.struct("at", "bigram", "first", "last"))).alias("hits"), F.count_distinct("bigram").alias("common")
    )
    part = part.filter(F.col("common") >= smallest * F.col("size"))
    windows = F.transform(_windows(F.col("hits"), F.col("words"), F.col("size"), min_dice), lambda w: F.struct(w["less"].alias("less"), w["shorter"].alias("shorter"), F.col("license").alias("license"), *[w[c].alias(c) for c in ("at", "until", "line", "lines")]))
    part = part.withColumn("windows", windows).filter(F.size("windows") > 0)
    part = part.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("windows"))).alias("windows"))
    part = part.select("doc_id", "text_hash", F.explode(_apart(F.col("windows"))).alias("w")).select(*key[:2], "w.line", "w.lines", "w.license", "w.less")
    over = best.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("line").alias("__line"), F.col("lines").alias("__lines"))
    inside = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")) & (F.col("line") >= F.col("__line")) & (F.col("line") + F.col("lines") <= F.col("__line") + F.col("__lines"))
    part = part.join(over, inside, "left_anti").groupBy("doc_id", "line", "lines", "license").agg((-F.min("less")).alias("dice"))
    best = best.groupBy("doc_id", "line", "lines").agg(F.min("best").alias("best"))
    return best.select("doc_id", "line", "lines", "best.license", (-F.col("best.less")).alias("dice")).unionByName(part)
