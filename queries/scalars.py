"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import constants as K
from faultlens.functions import clock, naming, spans as S, text
from faultlens.operators import evaluation
from faultlens.plans import views
from faultlens.sources.aliases import alias_table, canonical_service
from oracles.stages import (
    CONT, bucket_sql, any_of, fault_category_sql, keyword_sql, mask_sql, metric_service_sql, quoted, tokens_sql,
)
from queries.common import events, investigation

QUERIES, SQL = {}, {}


def register(name, sql):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return add


RAW_EPOCH = """CASE event_id % 5 WHEN 0 THEN CAST({us} AS DOUBLE) / 1000000.0 WHEN 1 THEN CAST({us} AS DOUBLE) / 1000.0
 WHEN 2 THEN CAST({us} AS DOUBLE) WHEN 3 THEN CAST({us} AS DOUBLE) * 1000.0 END"""


@register(
    "epoch_seconds",
    f"""SELECT event_id, round(CASE WHEN v IS NULL THEN 0.0 WHEN v > 1e16 THEN v / 1e9 WHEN v > 1e13 THEN v / 1e6
        WHEN v > 1e10 THEN v / 1e3 ELSE v END, 3) AS seconds FROM (SELECT event_id, {RAW_EPOCH.format(us='epoch_us(ts)')} AS v FROM events)""",
)
def epoch_seconds(spark, sf):
    raw = RAW_EPOCH.format(us="unix_micros(CAST(ts AS TIMESTAMP))").replace("1000000.0", "1000000.0D").replace("/ 1000.0", "/ 1000.0D").replace("* 1000.0", "* 1000.0D")
    d = events(spark, sf).selectExpr("event_id", f"{raw} AS v")
    return d.select("event_id", F.round(clock.epoch_seconds(F.col("v")), 3).alias("seconds"))


@register(
    "parse_ts",
    """SELECT event_id, round(CASE event_id % 7 WHEN 0 THEN epoch_us(ts) / 1000000 WHEN 1 THEN (epoch_us(ts) // 1000) / 1000.0 WHEN 2 THEN epoch_us(ts) / 1000000.0
        WHEN 3 THEN epoch_us(ts) // 1000000 WHEN 4 THEN epoch_us(ts) / 1000000.0 - 7200 WHEN 5 THEN 0.0 END, 3) AS seconds FROM events""",
)
def parse_ts(spark, sf):
    ts, us = F.col("ts").cast("timestamp"), F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.concat((us / 1000000).cast("bigint").cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0")))
        .when(k == 1, F.floor(us / 1000).cast("string"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .when(k == 6, F.lit("not a time"))
    )
    return events(spark, sf).select("event_id", F.round(clock.parse_ts(raw), 3).alias("seconds"))


@register(
    "canonical_service",
    """SELECT CASE WHEN user_id % 12 >= 10 THEN concat('edge', user_id % 12) ELSE concat('svc', user_id % 12) END AS service,
              CAST(count(*) AS BIGINT) AS rows_seen FROM events GROUP BY ALL""",
)
def canonical(spark, sf):
    d = events(spark, sf).selectExpr(
        "CASE WHEN user_id % 12 >= 10 THEN concat('edge', CAST(user_id % 12 AS STRING))"
        " WHEN event_id % 2 = 0 THEN concat('unknown_service:svc', CAST(user_id % 12 AS STRING))"
        " ELSE concat('svc', CAST(user_id % 12 AS STRING)) END AS service"
    )
    names = views.raw_logs(spark, sf).select("service").distinct().filter("service NOT IN ('svc10', 'svc11')")
    return canonical_service(d, alias_table(names)).groupBy("service").agg(F.count(F.lit(1)).alias("rows_seen"))


LINE = "SELECT seq, line FROM lines"


@register("match_keyword", f"SELECT seq, {keyword_sql('lower(line)')} AS keyword FROM ({LINE})")
def match_keyword(spark, sf):
    return investigation(spark, sf).lines.select("seq", text.match_keyword(F.col("line")).alias("keyword"))


@register("is_probe", f"SELECT seq, {any_of('lower(line)', K.PROBE_MARKS)} AS probe FROM ({LINE})")
def is_probe(spark, sf):
    return investigation(spark, sf).lines.select("seq", text.is_probe(F.col("line")).alias("probe"))


TAG_TEXT = """CASE event_id % 4 WHEN 0 THEN concat('got trace_id=AB', CAST(event_id AS STRING), ' ok') WHEN 1 THEN concat('[Worker-', CAST(event_id AS STRING), 'xyz] ', event_type)
 WHEN 2 THEN concat('thread: T', CAST(user_id AS STRING), ' ', event_type) ELSE concat('[ab] ', event_type) END"""


@register(
    "correlation_tag",
    """SELECT event_id, lower(coalesce(nullif(regexp_extract(t, '(?:trace_?id|req(?:uest)?_?id|thread|worker)[=:\\s]+([a-zA-Z0-9_\\-]+)', 1, 'i'), ''),
        nullif(regexp_extract(t, '\\[([a-zA-Z0-9_\\-]{6,})\\]', 1), ''))) AS tag FROM (SELECT event_id, """
    + TAG_TEXT.replace("STRING", "VARCHAR")
    + " AS t FROM events)",
)
def correlation_tag(spark, sf):
    d = events(spark, sf).selectExpr("event_id", f"{TAG_TEXT} AS t")
    return d.select("event_id", text.correlation_tag(F.col("t")).alias("tag"))


STACK_TEXT = """CASE event_id % 7 WHEN 0 THEN concat('  frame ', CAST(user_id AS STRING)) WHEN 1 THEN concat('at Class.method', CAST(user_id AS STRING))
 WHEN 2 THEN 'Caused by: timeout' WHEN 3 THEN concat('goroutine ', CAST(user_id AS STRING), ' [running]') WHEN 4 THEN '   ' WHEN 5 THEN 'Traceback (most recent call last):'
 ELSE concat('served ', event_type) END"""


@register(
    "is_continuation",
    f"SELECT event_id, {CONT} AS continues FROM (SELECT event_id, {STACK_TEXT.replace('STRING', 'VARCHAR')} AS line FROM events)",
)
def is_continuation(spark, sf):
    d = events(spark, sf).selectExpr("event_id", f"{STACK_TEXT} AS line")
    return d.select("event_id", text.is_continuation(F.col("line")).alias("continues"))


MASK_TEXT = """concat(message, ' from 10.0.', CAST(seq % 256 AS STRING), '.7 id 0f8fad5b-d9cb-469f-a165-70867728950e at 2024-01-02 03:04:05.', CAST(seq AS STRING), ' key=a_', CAST(seq AS STRING))"""


@register("mask_line", f"SELECT seq, {mask_sql('t')} AS masked FROM (SELECT seq, {MASK_TEXT.replace('STRING', 'VARCHAR')} AS t FROM v_logs)")
def mask_line(spark, sf):
    d = investigation(spark, sf).raw_logs.selectExpr("seq", f"{MASK_TEXT} AS t")
    return d.select("seq", text.mask_line(F.col("t")).alias("masked"))


@register("tokenize", f"SELECT seq, replace(tk, ' ', '|') AS tokens, len(string_split(tk, ' ')) AS n FROM (SELECT seq, {tokens_sql(mask_sql('trim(line)'))} AS tk FROM lines)")
def tokenize(spark, sf):
    tokens = text.tokenize(text.mask_line(text.strip(F.col("line"))))
    return investigation(spark, sf).lines.select(
        "seq", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("bigint").alias("n")
    )


@register(
    "est_tokens",
    "SELECT doc_id, greatest(1, length(text) // 4) AS by_four, greatest(1, length(text) // 3) AS by_three FROM documents",
)
def est_tokens(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", text.est_tokens(F.col("text")).alias("by_four"), text.est_tokens(F.col("text"), 3).alias("by_three")
    )


METRIC_TEXT = """CASE event_id % 6 WHEN 0 THEN concat('svc', CAST(user_id AS STRING), '/cpu_seconds') WHEN 1 THEN concat('container_memory_bytes{name="svc', CAST(user_id AS STRING), '"}')
 WHEN 2 THEN 'http_requests_total' WHEN 3 THEN concat('svc', CAST(user_id AS STRING), '_latency') WHEN 4 THEN 'uptime' ELSE '/heap' END"""
QUERY_TEXT = "CASE WHEN event_id % 18 = 2 THEN concat('{app=''svc', CAST(user_id AS STRING), '''}') ELSE 'q' END"


@register(
    "metric_service",
    f"SELECT event_id, {metric_service_sql('n', 'q')} AS service FROM (SELECT event_id, {METRIC_TEXT.replace('STRING', 'VARCHAR')} AS n, {QUERY_TEXT.replace('STRING', 'VARCHAR')} AS q FROM events)",
)
def metric_service(spark, sf):
    d = events(spark, sf).selectExpr("event_id", f"{METRIC_TEXT} AS n", f"{QUERY_TEXT_SPARK} AS q")
    return d.select("event_id", naming.metric_service(F.col("n"), F.col("q")).alias("service"))


QUERY_TEXT_SPARK = "CASE WHEN event_id % 18 = 2 THEN concat(\"{app='svc\", CAST(user_id AS STRING), \"'}\") ELSE 'q' END"


@register(
    "metric_kind",
    f"SELECT event_id, {any_of('lower(n)', K.MEMORY_MARKS)} AS memory, {any_of('lower(n)', K.LATENCY_MARKS)} AS latency, {any_of('lower(n)', K.LIMIT_MARKS)} AS is_limit"
    f" FROM (SELECT event_id, {METRIC_TEXT.replace('STRING', 'VARCHAR')} AS n FROM events)",
)
def metric_kind(spark, sf):
    kind = naming.metric_kind(F.col("n"))
    return events(spark, sf).selectExpr("event_id", f"{METRIC_TEXT} AS n").select(
        "event_id", kind["memory"].alias("memory"), kind["latency"].alias("latency"), kind["limit"].alias("is_limit")
    )


@register("span_service", "SELECT span_id, service FROM v_spans")
def span_service(spark, sf):
    return investigation(spark, sf).raw_spans.select("span_id", S.span_service(F.col("tags")).alias("service"))


@register(
    "span_error",
    "SELECT span_id, status = 504 OR logged_timeout AS is_error, status AS status_code,"
    " CASE WHEN logged_timeout THEN 'upstream timeout' END AS error_message FROM v_spans",
)
def span_error(spark, sf):
    e = S.span_error(F.col("tags"), F.col("logs"))
    return investigation(spark, sf).raw_spans.select("span_id", e.alias("e")).select(
        "span_id", "e.is_error", F.col("e.status_code").cast("bigint").alias("status_code"), "e.error_message"
    )


STATUS = "CASE l_orderkey % 7 WHEN 0 THEN ' Error ' WHEN 1 THEN '504' WHEN 2 THEN '200' WHEN 3 THEN 'failed' WHEN 4 THEN 'TRUE' WHEN 5 THEN '1' ELSE 'ok' END"


@register(
    "status_tags",
    f"""SELECT l_orderkey, l_linenumber, lower(trim(s)) IN ({quoted(K.ERROR_STATUS_WORDS)}) AS error_tag,
        lower(trim(s)) IN ({quoted(K.ERROR_STATUS_WORDS_CSV)}) AS error_tag_csv, CASE WHEN regexp_matches(trim(s), '^[0-9]+$') THEN trim(s) END AS code
        FROM (SELECT *, {STATUS} AS s FROM lineitem)""",
)
def status_tags(spark, sf):
    d = views.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{STATUS} AS s")
    has = lambda tags: F.exists(tags, lambda t: t["key"] == "error")
    plain, csv = S.status_tags(F.col("s")), S.status_tags(F.col("s"), "csv")
    code = F.get(F.filter(plain, lambda t: t["key"] == "http.status_code"), F.lit(0))["value"]
    return d.select("l_orderkey", "l_linenumber", has(plain).alias("error_tag"), has(csv).alias("error_tag_csv"), code.alias("code"))


PARENT = "CASE l_linenumber % 5 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN concat(' p', CAST(l_partkey AS STRING), ' ') END"


@register(
    "clean_ids",
    f"""SELECT l_orderkey, span_id, CAST(count(*) AS BIGINT) AS n, CAST(count(parent_id) AS BIGINT) AS with_parent FROM (
          SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN concat('s', l_partkey)
                    ELSE concat(l_orderkey, '_', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) END AS span_id,
                 CASE WHEN trim(p) NOT IN ({quoted(K.NULL_PARENTS)}) THEN trim(p) END AS parent_id
          FROM (SELECT *, {PARENT.replace('STRING', 'VARCHAR')} AS p FROM lineitem)) GROUP BY ALL""",
)
def clean_ids(spark, sf):
    from faultlens.sources.spans import clean_ids as clean

    d = views.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CAST(l_orderkey AS STRING) AS trace_id", "'c' AS case_id",
        "CASE WHEN l_quantity > 25 THEN concat('s', CAST(l_partkey AS STRING)) END AS span_id",
        f"{PARENT} AS parent_id", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place",
    )
    return clean(d, ["place"], F.col("place.l_linenumber")).groupBy("l_orderkey", "span_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("parent_id").alias("with_parent")
    )


@register(
    "duration_us",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_extendedprice) AS BIGINT) AS as_parquet,
       CAST(trunc(CASE WHEN l_extendedprice < 100000 THEN l_extendedprice * 1000 ELSE l_extendedprice END) AS BIGINT) AS as_csv_ms,
       CAST(trunc(l_extendedprice) AS BIGINT) AS as_csv_us FROM lineitem""",
)
def duration_us(spark, sf):
    v = F.col("l_extendedprice")
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.duration_us(v, "duration_ms").alias("as_parquet"),
        S.duration_us(v, "duration_ms", "csv").alias("as_csv_ms"),
        S.duration_us(v, "duration_us", "csv").alias("as_csv_us"),
    )


@register("incident_id", "SELECT event_id, concat('INC-', upper(substr(sha256(concat('run_', event_id)), 1, 8))) AS incident FROM events")
def incident_id(spark, sf):
    return events(spark, sf).select(
        "event_id", naming.incident_id(F.concat(F.lit("run_"), F.col("event_id").cast("string"))).alias("incident")
    )


LABEL = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate([f"{k.lower()} " for k in K.FAULT_TO_CATEGORY])) + " ELSE 'odd' END"


@register(
    "fault_category",
    f"SELECT event_id, {fault_category_sql('f')} AS category, {fault_category_sql('f')} = '{K.EC1}' AS matches_ec1 FROM (SELECT event_id, {LABEL} AS f FROM events)",
)
def fault_category(spark, sf):
    d = events(spark, sf).selectExpr("event_id", f"{LABEL} AS f")
    return d.select(
        "event_id", naming.fault_category(F.col("f")).alias("category"), naming.fault_matches(F.lit(K.EC1), F.col("f")).alias("matches_ec1")
    )


@register(
    "error_bucket",
    f"SELECT event_id, {bucket_sql('a', 'b', 'c')} AS bucket FROM (SELECT event_id, event_id % 2 = 0 AS a, event_id % 2 = 0 OR event_id % 3 = 0 AS b, user_id % 2 = 0 AS c FROM events)",
)
def error_bucket(spark, sf):
    d = events(spark, sf).selectExpr("event_id", "event_id % 2 = 0 AS a", "event_id % 2 = 0 OR event_id % 3 = 0 AS b", "user_id % 2 = 0 AS c")
    return d.select("event_id", naming.error_bucket(F.col("a"), F.col("b"), F.col("c")).alias("bucket"))


CASE_NAME = "CASE event_id % 3 WHEN 0 THEN concat('re2ob_svc', CAST(user_id AS STRING), '_cpu_', CAST(event_id AS STRING)) WHEN 1 THEN concat('re1_tt_svc', CAST(user_id AS STRING), '_loss_', CAST(event_id AS STRING)) ELSE concat('case', CAST(event_id AS STRING)) END"


@register(
    "ground_truth",
    f"""SELECT c AS case_id, CASE WHEN known THEN 'svcR' WHEN k = 2 THEN 'unknown' ELSE concat('svc', user_id) END AS gt_service,
        CASE WHEN known THEN 'disk' WHEN k = 0 THEN 'CPU' WHEN k = 1 THEN 'LOSS' ELSE 'unknown' END AS gt_fault,
        CASE WHEN known THEN 'RX' WHEN k = 0 THEN 're2ob' WHEN k = 1 THEN 're1' ELSE c END AS dataset,
        CASE k WHEN 0 THEN 'RE2OB' WHEN 1 THEN 'RE1' ELSE 'UNKNOWN' END AS suite
        FROM (SELECT *, event_id % 3 AS k, {CASE_NAME.replace('STRING', 'VARCHAR')} AS c, event_type = 'error' AS known FROM events)""",
)
def ground_truth(spark, sf):
    d = events(spark, sf).selectExpr(f"{CASE_NAME} AS case_id", "event_type")
    registry = d.filter("event_type = 'error'").selectExpr("case_id", "'svcR' AS gt_service", "'disk' AS gt_fault", "'RX' AS dataset")
    return evaluation.ground_truth(d.drop("event_type"), registry)


@register("format_line", "SELECT seq, line, round(ts, 5) AS back FROM lines")
def format_line(spark, sf):
    d = investigation(spark, sf).raw_logs.select("seq", clock.format_line(F.col("ts"), F.col("message")).alias("line"))
    return d.select("seq", "line", F.round(clock.line_ts(F.col("line")), 5).alias("back"))
