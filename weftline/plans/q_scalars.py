"""Scalar functions over the document, page and event tables and over literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import duck as D
from .registry import derived, query, table


def sorted_text(c):
    return F.array_join(F.array_sort(c), "|")


@query("x01_normalize_text", f"SELECT doc_id, {D.normalize('text')} AS norm FROM documents")
def x01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("x02_url_host", f"SELECT page_id, {D.host_of('url')} AS host FROM pages")
def x02(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))


HOSTS = D.rows("v", "('https://WWW.Example.com/x')", "('a.com')", "(' sub.A.com/path ')", "('')", "('http://user@b.org:8080/q?x=1')", "('not a host')", "('www.c.net')", "(NULL)", "('ftp://d.io')")


@query("x03_normalize_host", f"SELECT v, {D.normalize_host('v')} AS host FROM ({HOSTS}) UNION ALL SELECT url, {D.normalize_host('url')} FROM pages")
def x03(spark, sf):
    own = spark.sql(HOSTS).union(table(spark, sf, "pages").select("url"))
    return own.select("v", U.normalize_host(F.col("v")).alias("host"))


@query("x04_match_normalize", f"SELECT doc_id, {D.for_matching('text')} AS norm, {D.for_matching('text', True)} AS target FROM documents")
def x04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.for_matching(F.col("text")).alias("norm"), T.for_matching(F.col("text"), True).alias("target"))


@query("x05_key_words", f"SELECT doc_id, len(k)::BIGINT AS n, array_to_string(list_sort(k), '|') AS words FROM (SELECT doc_id, {D.key_words(D.for_matching('text'))} AS k FROM documents)")
def x05(spark, sf):
    k = T.key_words(T.for_matching(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("bigint").alias("n"), sorted_text("k").alias("words"))


@query("x06_word_set", f"SELECT conv_id, turn, array_to_string(list_sort({D.words(D.for_matching('text', True))}), '|') AS words FROM conversations")
def x06(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", sorted_text(T.words(T.for_matching(F.col("text"), True))).alias("words"))


NEIGHBOURS = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


def neighbours(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    return spark.sql(NEIGHBOURS.replace("FROM conversations", "FROM conversations_in"))


@query(
    "x07_overlap_of_larger",
    f"SELECT conv_id, turn, round({D.overlap_of_larger('a', 'b')}, 6) AS score FROM (SELECT conv_id, turn, {D.key_words(D.for_matching('text'))} AS a, {D.key_words(D.for_matching('before'))} AS b FROM ({NEIGHBOURS}))",
)
def x07(spark, sf):
    a, b = (T.key_words(T.for_matching(F.col(c))) for c in ("text", "before"))
    return neighbours(spark, sf).select("conv_id", "turn", a.alias("a"), b.alias("b")).select("conv_id", "turn", F.round(T.overlap_of_larger(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    "x08_overlap_of_first",
    f"SELECT conv_id, turn, round({D.overlap_of_first('a', 'b')}, 6) AS score FROM (SELECT conv_id, turn, {D.words(D.for_matching('text', True))} AS a, {D.words(D.for_matching('before', True))} AS b FROM ({NEIGHBOURS}))",
)
def x08(spark, sf):
    a, b = (T.words(T.for_matching(F.col(c), True)) for c in ("text", "before"))
    return neighbours(spark, sf).select("conv_id", "turn", a.alias("a"), b.alias("b")).select("conv_id", "turn", F.round(T.overlap_of_first(F.col("a"), F.col("b")), 6).alias("score"))


@query("x09_length_ratio", f"SELECT conv_id, turn, round({D.length_ratio('text', 'before')}, 6) AS score FROM ({NEIGHBOURS})")
def x09(spark, sf):
    return neighbours(spark, sf).select("conv_id", "turn", F.round(T.length_ratio(F.col("text"), F.col("before")), 6).alias("score"))


@query("x13_emails", f"SELECT doc_id, {D.found_sorted('text', T.EMAIL)} AS emails FROM documents")
def x13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sorted_text(T.found(F.col("text"), T.EMAIL)).alias("emails"))


@query("x14_phones", f"SELECT doc_id, {D.found_sorted('text', T.PHONE)} AS phones FROM documents")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sorted_text(T.found(F.col("text"), T.PHONE)).alias("phones"))


@query("x15_domains", f"SELECT doc_id, {D.found_sorted('lower(text)', T.DOMAIN)} AS domains FROM documents")
def x15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sorted_text(T.domains(F.col("text"))).alias("domains"))


WRAPPED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN 'Here it is: ' || props || ' as asked.' WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE 'no object' END AS reply FROM events"""


@query("x17_parse_json", f"""WITH r AS ({WRAPPED}), c AS (SELECT event_id, trim(regexp_replace(reply, '```json\\n?|```\\n?', '', 'g')) AS t FROM r),
p AS (SELECT event_id, CASE WHEN t <> '' AND json_valid(t) THEN t WHEN regexp_extract(t, '(?s)\\{{.*\\}}') <> '' AND json_valid(regexp_extract(t, '(?s)\\{{.*\\}}')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS j FROM c)
SELECT event_id, j IS NOT NULL AS parsed, TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS k FROM p""")
def x17(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events_in")
    r = spark.sql(WRAPPED.replace("FROM events", "FROM events_in"))
    return r.select("event_id", T.json_text(F.col("reply")).alias("j")).select("event_id", F.col("j").isNotNull().alias("parsed"), F.get_json_object("j", "$.k").cast("bigint").alias("k"))


BLOCKS = """SELECT conv_id * 100 + turn AS i, CASE turn % 5 WHEN 0 THEN '<blocks>' || text || '</blocks>' WHEN 1 THEN 'x <BLOCKS>' || substr(text, 1, 40) || '</blocks> <blocks>two</blocks>' WHEN 2 THEN text WHEN 3 THEN '<blocks></blocks>' || role ELSE NULL END AS v FROM conversations"""


@query("x18_block_text", f"SELECT i, CASE WHEN b <> '' THEN b ELSE coalesce(v, '') END AS block FROM (SELECT i, v, regexp_extract(coalesce(v, ''), '(?is)<blocks>(.*?)</blocks>', 1) AS b FROM ({BLOCKS}))")
def x18(spark, sf):
    return derived(spark, sf, BLOCKS).select("i", T.block_text(F.col("v")).alias("block"))


MARKS = """SELECT conv_id * 100 + turn AS i, CASE turn % 4 WHEN 0 THEN 'x [DONE: ' || substr(replace(text, chr(10), ' '), 1, 50) || '] y [done:All ' || role || ']' WHEN 1 THEN '[DONE: ] [DONE:' || role || ']' WHEN 2 THEN text ELSE NULL END AS v FROM conversations"""


@query("x19_done_items", f"SELECT i, array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(v, ''), '(?i)\\[DONE:\\s*([^\\]]+)\\]', 1), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM ({MARKS})")
def x19(spark, sf):
    return derived(spark, sf, MARKS).select("i", F.array_join(T.done_items(F.col("v")), "|").alias("items"))


ESCAPES = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("x20_escapes", f"SELECT doc_id, {ESCAPES} AS html, replace({ESCAPES}, '''', '&#39;') AS quoted, replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') AS attribute FROM documents")
def x20(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.escape_html(t).alias("html"), T.escape_html(t, True).alias("quoted"), T.escape_attribute(t).alias("attribute"))


@query("x21_format_time", "SELECT event_id, strftime(ts, '%b ') || day(ts) || ', ' || strftime(ts, '%I:%M %p') AS label FROM events")
def x21(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "MMM d, hh:mm a").alias("label"))


@query("x22_without_first_token", r"SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '^[^\s]+\s*', '')) AS rest FROM conversations")
def x22(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.without_first_token(F.col("text")).alias("rest"))


@query("x23_token_label", "SELECT k, CASE WHEN n >= 1000000 THEN ((n + 5000) // 10000 // 100) || '.' || lpad(((n + 5000) // 10000 % 100)::VARCHAR, 2, '0') || 'M' WHEN n >= 1000 THEN ((n + 50) // 100 // 10) || '.' || ((n + 50) // 100 % 10) || 'k' ELSE n::VARCHAR END AS label FROM (SELECT l_orderkey AS k, l_linenumber AS j, (l_extendedprice * l_quantity)::BIGINT AS n FROM lineitem)")
def x23(spark, sf):
    n = F.rint(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), T.token_count_label(n).alias("label"))


STATES = ", ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STATUS_LABELS.items()).replace(", WHEN", " WHEN")
SPANS = """SELECT event_id AS i, value * 40 AS s, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'done' WHEN 'error' THEN 'running' WHEN 'signup' THEN 'paused' ELSE event_type END AS state FROM events"""


@query("x24_session_labels", f"SELECT i, CASE WHEN s < 60 THEN floor(s)::BIGINT || 's' ELSE (floor(s)::BIGINT // 60) || 'm ' || (floor(s)::BIGINT % 60) || 's' END AS elapsed, CASE state {STATES} ELSE state END AS status FROM ({SPANS})")
def x24(spark, sf):
    return derived(spark, sf, SPANS).select("i", T.elapsed_label(F.col("s")).alias("elapsed"), T.status_label(F.col("state")).alias("status"))


def _markdown_sql(x: str) -> str:
    for pattern, by in T.MARKDOWN_STEPS:
        by = by.replace("$1", r"\1")
        x = f"regexp_replace({x}, {D.lit(pattern)}, {D.lit(by)}, 'g')" if pattern not in (r"\A", r"\z") else (f"({D.lit(by)} || {x})" if pattern == r"\A" else f"({x} || {D.lit(by)})")
    return x


MARKDOWN = "SELECT doc_id, '# Title' || chr(10) || chr(10) || '- **' || lang || '** item' || chr(10) || '2. *' || source || '* [3]' || chr(10) || chr(10) || text AS md FROM documents"


@query("x25_markdown_html", f"SELECT doc_id, {_markdown_sql('md')} AS html FROM ({MARKDOWN})")
def x25(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents_in")
    return spark.sql(MARKDOWN.replace("FROM documents", "FROM documents_in")).select("doc_id", T.markdown_to_html(F.col("md")).alias("html"))


@query("x25b_result_html", f"SELECT doc_id, replace(regexp_replace(regexp_replace({D.sub('e', 'QQ', 'QQ')}, '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), '(?m)^(\\s*)[-*]\\s+(.*)$', '\\1• \\2', 'g'), chr(10), '<br>') AS html FROM (SELECT doc_id, replace(replace(replace(replace(replace(md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS e FROM ({MARKDOWN}))")
def x25b(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents_in")
    return spark.sql(MARKDOWN.replace("FROM documents", "FROM documents_in")).select("doc_id", T.result_to_html(F.col("md")).alias("html"))


SCROLLS = """SELECT l_orderkey * 10 + l_linenumber AS i, l_partkey * 37 % 3000 AS top, 800 AS ch, 300 + l_suppkey * 7 * l_linenumber % 3000 AS h FROM lineitem"""


@query("x29_scroll_state", f"SELECT i, CASE WHEN h > ch THEN floor(top * 100.0e0 / (h - ch) + 0.5e0)::BIGINT ELSE 100 END AS percent, top <= 4 AS at_top, top + ch >= h - 8 AS at_bottom FROM ({SCROLLS})")
def x29(spark, sf):
    top, ch, h = F.col("top"), F.col("ch"), F.col("h")
    percent = F.when(h > ch, F.floor(top * 100.0 / (h - ch) + 0.5)).otherwise(100).cast("bigint")
    return derived(spark, sf, SCROLLS).select("i", percent.alias("percent"), (top <= 4).alias("at_top"), (top + ch >= h - 8).alias("at_bottom"))


MEDIA = """SELECT conv_id * 100 + turn AS i, CASE turn % 5 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'x/jpg' WHEN 2 THEN NULL WHEN 3 THEN 'webp' ELSE 'image/gif ' || role END AS mime, CASE (conv_id + turn) % 4 WHEN 0 THEN 'data:image/png;base64,' || text WHEN 1 THEN 'data:image/x' WHEN 2 THEN NULL ELSE text END AS data FROM conversations"""


@query("x30_media", f"""SELECT i, CASE WHEN contains(m, 'png') THEN 'image/png' WHEN contains(m, 'webp') THEN 'image/webp' WHEN contains(m, 'gif') THEN 'image/gif' ELSE 'image/jpeg' END AS mime,
CASE WHEN starts_with(b, 'data:image') AND contains(b, ',') THEN regexp_replace(b, '^[^,]*,', '') ELSE b END AS data FROM (SELECT i, lower(coalesce(mime, '')) AS m, regexp_replace(coalesce(data, ''), '\\s+', '', 'g') AS b FROM ({MEDIA}))""")
def x30(spark, sf):
    return derived(spark, sf, MEDIA).select("i", T.mime_type(F.col("mime")).alias("mime"), T.base64_text(F.col("data")).alias("data"))


SERVICES = """SELECT page_id AS i, CASE page_id % 6 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'kimi' WHEN 2 THEN 'GLM' WHEN 3 THEN 'custom' WHEN 4 THEN 'other' ELSE NULL END AS provider, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN ' ' WHEN 2 THEN url || '/v1/' WHEN 3 THEN url || '/chat/completions' WHEN 4 THEN NULL WHEN 5 THEN url || '/api/x' ELSE url || '/V4//' END AS custom FROM pages"""
SERVICE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.SERVICE_URLS.items())


@query("x31_service_url", f"""SELECT i, CASE WHEN o = '' THEN CASE lower(coalesce(provider, '')) {SERVICE_CASES} ELSE '' END WHEN ends_with(lower(o), '/v1') OR ends_with(lower(o), '/v4') OR contains(lower(o), '/api/') THEN o ELSE o || '/v1' END AS base,
regexp_replace(trim(CASE WHEN coalesce(custom, '') = '' THEN 'http://127.0.0.1:11434' ELSE custom END), '/+$', '') AS local_base
FROM (SELECT *, regexp_replace(regexp_replace(trim(coalesce(custom, '')), '/+$', ''), '/+(chat/)?completions$', '') AS o FROM ({SERVICES}))""")
def x31(spark, sf):
    return derived(spark, sf, SERVICES).select("i", U.service_base_url(F.col("provider"), F.col("custom")).alias("base"), U.local_base_url(F.col("custom")).alias("local_base"))


@query("s04_search_url", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'https://duckduckgo.com/?q=' || q || '&ia=web' WHEN turn % 3 = 1 THEN 'https://www.bing.com/search?q=' || q ELSE 'https://www.google.com/search?q=' || q END AS url
FROM (SELECT conv_id, turn, replace(replace(replace(replace(replace(url_encode(trim(text)), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS q FROM conversations)""")
def s04(spark, sf):
    engine = F.when(F.col("turn") % 3 == 0, "duckduckgo").when(F.col("turn") % 3 == 1, "Bing").otherwise("none")
    return table(spark, sf, "conversations").select("conv_id", "turn", U.search_url(engine, F.col("text")).alias("url"))


HINTS = """SELECT page_id AS i, CASE page_id % 5 WHEN 0 THEN url || ', b.org' WHEN 1 THEN 'a.com' || chr(10) || url || ',,c.net ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE substr(url, 9) END AS v FROM pages"""


@query("p21_site_hints", f"SELECT i, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(coalesce(v, ''), '[\\n,]'), lambda x: {D.normalize_host('x')}), lambda h: h <> ''))), '|') AS hosts FROM ({HINTS})")
def p21(spark, sf):
    return derived(spark, sf, HINTS).select("i", sorted_text(U.site_hints(F.col("v"))).alias("hosts"))


NUMBERS = """SELECT CASE event_id % 5 WHEN 0 THEN event_id % 20 || 'abc' WHEN 1 THEN ' ' || event_id % 9 WHEN 2 THEN '-' || event_id % 5 WHEN 3 THEN NULL ELSE substr(props, 7, 3) END AS v FROM events"""


@query("t09_clamp", f"SELECT v, CASE WHEN n = '' THEN 4 ELSE greatest(1, least(6, n::BIGINT)) END::BIGINT AS queries, CASE WHEN n = '' THEN 50 ELSE greatest(2, least(12, n::BIGINT)) END::BIGINT AS sites FROM (SELECT v, regexp_extract(coalesce(v, ''), '^\\s*([+-]?\\d+)', 1) AS n FROM ({NUMBERS}))")
def t09(spark, sf):
    v = F.col("v")
    return derived(spark, sf, NUMBERS).select("v", T.clamp_int(v, 1, 6, 4).alias("queries"), T.clamp_int(v, 2, 12, 50).alias("sites"))
