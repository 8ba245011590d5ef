"""One query for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from faultlens.llm import archives, decontam, interactions, licenses, lines, lm, middle, neardup, packing, quality, secret_scan, substring, suffix
from faultlens.llm.common import table
from faultlens.plans.materialize import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_dedup(spark, sf_dir):
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


def op2_mixture_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op3_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secret_scan.KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans")).alias("spans"),
    )


def op4_masked_lm_score(spark, sf_dir):
    found = lm.train_and_score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_prob", 3).alias("log_prob"), F.round("mean_log_prob", 4).alias("mean_log_prob"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_benchmark_decontamination(spark, sf_dir):
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "matched")


def op7_substring_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_minhash_neardup(spark, sf_dir):
    found = neardup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("class_id", "class_size", "kept")])


def op10_suffix_dedup(spark, sf_dir):
    return suffix.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_arc_to_warc(spark, sf_dir):
    return archives.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "llm-archives")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def op12_fill_in_middle(spark, sf_dir):
    return middle.transform(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(), 256).alias("restored_sha256"),
    )


def op13_filter_audit(spark, sf_dir):
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_mixture_packing,
        op3_secret_scan,
        op4_masked_lm_score,
        op5_quality_rules,
        op6_benchmark_decontamination,
        op7_substring_dedup,
        op8_license_scan,
        op9_minhash_neardup,
        op10_suffix_dedup,
        op11_arc_to_warc,
        op12_fill_in_middle,
        op13_filter_audit,
    )
}
SQL: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]+"

#: Words of letters and digits, in lower case.
_PLAIN = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _seed_sql(mask: str) -> str:
    seen = ", ".join(f"w[i + {j}]" for j, c in enumerate(mask) if c == "1")
    return f"SELECT *, '{mask}' AS mask, [{seen}] AS seed FROM windows WHERE i + {len(mask) - 1} <= len(w)"


SQL["op6_benchmark_decontamination"] = f"""
WITH words AS (
  SELECT doc_id AS id, true AS is_doc, {_PLAIN} AS w FROM documents UNION ALL SELECT item_id, false, {_PLAIN} FROM benchmark),
windows AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words),
short AS (SELECT DISTINCT len(w) AS n FROM words WHERE NOT is_doc AND len(w) BETWEEN {decontam.MIN_PASSAGE} AND {decontam.MIN_SCORE - 1}),
seeds AS ({" UNION ALL ".join(_seed_sql(m) for m in decontam.MASKS)}
  UNION ALL SELECT id, is_doc, w, i, 'passage', w[i:i + n - 1] FROM windows, short WHERE i + n - 1 <= len(w)
  UNION ALL SELECT id, is_doc, w, i, 'whole', w FROM windows WHERE i = 1 AND len(w) < {decontam.MIN_PASSAGE}),
hits AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.w AS doc, b.w AS item, d.i - b.i AS diagonal, least(len(b.w), {decontam.MIN_SCORE}) AS needed
  FROM seeds d JOIN seeds b ON d.mask = b.mask AND d.seed = b.seed WHERE d.is_doc AND NOT b.is_doc),
places AS (SELECT *, unnest(range(greatest(1, 1 - diagonal), least(len(item), len(doc) - diagonal) + 1)) AS p FROM hits),
points AS (SELECT doc_id, item_id, needed, diagonal, p, item[p] = doc[p + diagonal] AS same FROM places),
sums AS (
  SELECT *, sum(CASE WHEN same THEN 1 ELSE -1 END) OVER w AS s, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER w AS e
  FROM points WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY p)),
lows AS (
  SELECT *, arg_min({{'s': s, 'e': e}}, {{'s': s, 'p': -p}}) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS low FROM sums),
stretches AS (
  SELECT doc_id, item_id, needed, diagonal, p, s - least(low.s, 0) AS score, e - CASE WHEN low.s <= 0 THEN low.e ELSE 0 END AS matched FROM lows),
best AS (
  SELECT doc_id, item_id, needed, diagonal, max({{'score': score, 'p': -p, 'matched': matched}}) AS b FROM stretches GROUP BY ALL),
pairs AS (
  SELECT doc_id, item_id, max({{'score': b.score, 'matched': b.matched}}) AS b FROM best WHERE b.score >= needed GROUP BY ALL)
SELECT doc_id, item_id, CAST(b.score AS BIGINT) AS score, CAST(b.matched AS BIGINT) AS matched FROM pairs"""

_TEMPLATES = ", ".join(
    "('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for name, several in licenses.TEMPLATES.items() for i, text in enumerate(several)
)
_BIGRAMS = "list_distinct(list_zip(w[:len(w) - 1], w[2:]))"

SQL["op8_license_scan"] = f"""
WITH listed AS (
  SELECT license, template, {_BIGRAMS} AS b FROM (SELECT license, template, {_PLAIN} AS w FROM (VALUES {_TEMPLATES}) t(license, template, text))),
numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
blocks AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM numbered),
paragraphs AS (
  SELECT doc_id, min(line) AS line, count(*) AS lines, string_agg(text, chr(10) ORDER BY line) AS text FROM blocks WHERE trim(text) <> '' GROUP BY doc_id, block),
passages AS (
  SELECT doc_id, line, lines, {_BIGRAMS} AS b FROM (
    SELECT doc_id, line, lines, {_PLAIN} AS w FROM (SELECT doc_id, line, 1 AS lines, text FROM numbered UNION ALL SELECT * FROM paragraphs WHERE lines > 1))),
asked AS (SELECT doc_id, line, lines, len(b) AS n, unnest(b) AS pair FROM passages WHERE len(b) <= (SELECT 2 * max(len(b)) FROM listed)),
wanted AS (SELECT license, template, len(b) AS m, unnest(b) AS pair FROM listed),
met AS (
  SELECT doc_id, line, lines, license, round(2 * count(*) / (any_value(n) + any_value(m)), 6) AS dice
  FROM asked JOIN wanted USING (pair) GROUP BY doc_id, line, lines, license, template),
best AS (SELECT doc_id, line, lines, license, dice, row_number() OVER (PARTITION BY doc_id, line, lines ORDER BY dice DESC, license) AS k FROM met)
SELECT doc_id, line, lines, license, dice FROM best WHERE k = 1 AND dice >= {licenses.MIN_DICE}"""

SQL["op1_line_dedup"] = f"""
WITH numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(line, '{_SPACE}'), lambda x: x <> '') AS w FROM numbered),
classes AS (
  SELECT w, len(w) AS n, min({{'d': doc_id, 'l': line_no}}) AS first FROM lines WHERE len(w) >= {lines.MIN_WORDS} GROUP BY w),
halves AS (
  SELECT *, unnest([{{'s': 0, 'k': w[:n // 2]}}, {{'s': 0, 'k': w[:(n - 1) // 2]}}, {{'s': 1, 'k': w[n // 2 + 1:]}}, {{'s': 1, 'k': w[(n - 1) // 2 + 2:]}}]) AS half
  FROM classes WHERE n >= {lines.MIN_WORDS_NEAR}),
near AS (
  SELECT DISTINCT a.w FROM halves a JOIN halves b ON a.half = b.half AND b.first < a.first AND abs(a.n - b.n) <= 1
  WHERE len(list_filter(range(greatest(a.n, b.n)), lambda i:
    CASE WHEN a.n = b.n THEN list_concat(a.w[:i], a.w[i + 2:]) = list_concat(b.w[:i], b.w[i + 2:])
         WHEN a.n > b.n THEN list_concat(a.w[:i], a.w[i + 2:]) = b.w
         ELSE list_concat(b.w[:i], b.w[i + 2:]) = a.w END)) > 0),
gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN classes c ON l.w = c.w
  WHERE {{'d': l.doc_id, 'l': l.line_no}} > c.first OR l.w IN (SELECT w FROM near)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM numbered ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(len(string_split(d.text, chr(10))) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""

_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_COMMON = "[" + ", ".join(f"'{w}'" for w in quality.COMMON_WORDS) + "]"


def _js_sql(a: str, b: str) -> str:
    p, q = f"(x[1] / list_sum({a}))", f"(x[2] / list_sum({b}))"
    part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2(2 * {v} / ({p} + {q})) ELSE 0 END"
    value = f"list_sum(list_transform(list_zip({a}, {b}), lambda x: {part(p)} + {part(q)})) / 2"
    return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest({value}, 0)) ELSE 0 END"


SQL["op5_quality_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT r, unnest(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])) AS k, unnest(range(len(w) - 2)) AS i FROM docs WHERE len(w) > 2),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range(3) AS t(j) GROUP BY r),
base AS (
  SELECT d.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(t, '\\P{{Ll}}', '', 'g')) AS low, length(regexp_replace(t, '\\P{{N}}', '', 'g')) AS dig
  FROM docs d LEFT JOIN covered c USING (r)),
measured AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    [up, low, dig, length(t) - word_chars, n_symbols, greatest(0, word_chars - up - low - dig - n_symbols)] AS classes,
    list_transform({_COMMON}, lambda c: len(list_filter(w, lambda x: x = c))) AS known FROM base),
counted AS (SELECT *, list_append(known, n_words - list_sum(known)) AS common FROM measured),
cells AS (SELECT lang, unnest(classes || common) AS v, unnest(range(len(classes) + len(common))) AS i FROM counted WHERE NOT base_failed),
refs AS (SELECT lang, list(v ORDER BY i) AS v FROM (SELECT lang, i, sum(v) AS v FROM cells GROUP BY lang, i) GROUP BY lang),
judged AS (
  SELECT c.*, {_js_sql("classes", "f.v[:6]")} AS dc, {_js_sql("common", "f.v[7:]")} AS dw FROM counted c LEFT JOIN refs f ON c.lang IS NOT DISTINCT FROM f.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (dc > {quality.MAX_CLASS_DISTANCE} OR dw > {quality.MAX_WORD_DISTANCE}
    OR dc > {quality.BOTH_CLASS_DISTANCE} AND dw > {quality.BOTH_WORD_DISTANCE}) AS kept
FROM judged"""

SQL["op7_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {substring.WINDOW - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM docs)),
first AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN first USING (k), range({substring.WINDOW}) AS t(j) WHERE d < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)"""

_BASE32 = "[" + ", ".join(f"'{c}'" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + "]"
_TWENTY_BITS = "CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)"

# Five hexadecimal digits are four symbols of base 32.
SQL["op11_arc_to_warc"] = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
coded AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
    lambda k: {_BASE32}[CAST({_TWENTY_BITS} // k % 32 AS INT) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM coded"""

_DRAW = "CAST('0x' || substr(sha256('{seed}:' || doc_id), {at}, 8) AS BIGINT)"
_DRAWS = ", ".join(_DRAW.format(seed=middle.SEED, at=1 + 8 * i) + f" AS h{i + 1}" for i in range(4))

SQL["op12_fill_in_middle"] = f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_DRAWS} FROM documents),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {middle.PLAIN_FROM} THEN 'plain'
         WHEN h4 % 100 < {middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', mid) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', mid) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""

_FILTERS = ", ".join(f"'{f}'" for f in interactions.FILTERS)

SQL["op13_filter_audit"] = f"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_concat(
    CASE WHEN len(w) < {interactions.MIN_WORDS} THEN ['A'] ELSE [] END,
    CASE WHEN 100 * len(list_distinct(w)) < {interactions.MIN_DISTINCT_PERCENT} * len(w) THEN ['B'] ELSE [] END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {interactions.MAX_UPPER_PERCENT} * length(t) THEN ['C'] ELSE [] END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN ['E'] ELSE [] END) AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest([{_FILTERS}]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, o[:i - 1] AS earlier, o[i] AS f, i AS step FROM orders, range(1, 6) AS r(i)),
rows AS (
  SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INT) AS step, f,
    coalesce(sum(n) FILTER (WHERE NOT list_has_any(fails, list_append(earlier, f))), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND list_has_any(fails, earlier)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [f]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, o, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows"""
