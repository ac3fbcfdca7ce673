"""Agent plans, guards and context choices over conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of
from ..operators import agents as A
from ..operators import pages as P
from . import duck as D
from .q_pages import BODY, LINKS
from .registry import derived, query, table


def says_sql(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), {D.lit(p)})" for p in parts) + ")"


GUARDED = "SELECT conv_id, turn, text || CASE (conv_id + turn) % 8 WHEN 0 THEN ' Download CSV' WHEN 1 THEN ' checkout, sign up' WHEN 2 THEN ' register' WHEN 3 THEN ' OTP' WHEN 4 THEN ' camera' WHEN 5 THEN ' erase it' WHEN 6 THEN ' downloads' ELSE '' END AS said FROM conversations"
GUARD_CASE = " ".join(f"WHEN regexp_matches(lower('click ' || said), {D.lit(p)}) THEN '{k}'" for k, p in A.GUARDS)


@query("f05_action_guards", f"SELECT conv_id, turn, CASE {GUARD_CASE} END AS guard FROM ({GUARDED})")
def f05(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    own = spark.sql(GUARDED.replace("FROM conversations", "FROM conversations_in"))
    return own.select("conv_id", "turn", A.guard(F.lit("click"), F.lit(""), F.col("said")).alias("guard"))


@query("f06_unapproved_hosts", f"SELECT page_id, host FROM (SELECT page_id, {D.host_of('url')} AS host FROM pages) WHERE host <> '' AND host NOT IN (SELECT {D.host_of('url')} FROM pages WHERE page_id % 10 = 0)")
def f06(spark, sf):
    own = table(spark, sf, "pages").withColumn("type", F.when(F.col("page_id") % 2 == 0, "navigate").otherwise("new_tab"))
    approved = own.where("page_id % 10 = 0").select(host_of(F.col("url")).alias("host"))
    return A.unapproved_hosts(own, approved).select("page_id", "host")


ERRORS = """SELECT conv_id * 100 + turn AS i, CASE (conv_id + turn) % 8 WHEN 0 THEN 'HTTP 401 Unauthorized ' WHEN 1 THEN 'Quota exceeded ' WHEN 2 THEN 'timeout ' WHEN 3 THEN 'unsupported response_format ' WHEN 4 THEN 'Context length 400 ' WHEN 5 THEN 'Billing ' WHEN 6 THEN 'unable to download all specified images ' ELSE '' END || text AS message FROM conversations"""


@query("f07_error_kinds", f"SELECT i, {says_sql('message', A.FATAL)} AS fatal, {says_sql('message', A.IMAGE_ERRORS)} AS image, {says_sql('message', A.COMPATIBILITY_ERRORS)} AS compat FROM ({ERRORS})")
def f07(spark, sf):
    m = F.col("message")
    return derived(spark, sf, ERRORS).select("i", A.says_any(m, A.FATAL).alias("fatal"), A.says_any(m, A.IMAGE_ERRORS).alias("image"), A.says_any(m, A.COMPATIBILITY_ERRORS).alias("compat"))


@query("f08_compact_retry", f"SELECT i FROM ({ERRORS}) WHERE {says_sql('message', ('context length', 'prompt'))}")
def f08(spark, sf):
    return derived(spark, sf, ERRORS).where(A.says_any(F.col("message"), ("context length", "prompt"))).select("i")


MODELS = """SELECT p_partkey AS i, CASE p_partkey % 6 WHEN 0 THEN 'llama3.2:3b' WHEN 1 THEN p_name || ':' || p_size || 'b' WHEN 2 THEN lower(p_brand) || ':' || (p_size % 6) || '.5b' WHEN 3 THEN 'TinyLlama ' || p_name WHEN 4 THEN NULL ELSE p_name END AS name FROM part"""
SMALL = f"({says_sql('name', A.SMALL_MODELS)} OR coalesce(nullif(regexp_extract(lower(coalesce(name, '')), ':(\\d+(\\.\\d+)?)b', 1), '')::DOUBLE <= 4, false))"


@query("p09_small_models", f"SELECT i, {SMALL} AS small FROM ({MODELS})")
def p09(spark, sf):
    return derived(spark, sf, MODELS).select("i", A.small_model(F.col("name")).alias("small"))


SETTINGS = f"""(SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'Mistral' WHEN 2 THEN 'ollama' ELSE '' END AS provider, CASE page_id % 3 WHEN 0 THEN 'navigator' WHEN 1 THEN 'extractor' ELSE 'synthesizer' END AS role,
CASE page_id % 7 WHEN 0 THEN 'www.dropbox.com' ELSE {D.host_of('url')} END AS host, length({BODY}) * 3 AS size, (page_id % 60)::BIGINT AS n, (page_id % 11)::BIGINT AS tabs, CASE page_id % 13 WHEN 0 THEN 'deep_research' ELSE 'default' END AS profile, page_id % 17 = 0 AS forced, CASE page_id % 5 WHEN 0 THEN 'x:3b' ELSE 'x:70b' END AS model FROM pages)"""
HEAVY = f"regexp_matches(host, {D.lit(A.HEAVY_HOSTS)})"
MODE = f"""CASE WHEN forced THEN 'minimal' WHEN lower(provider) = 'ollama' AND {SMALL.replace('name', 'model')} THEN 'minimal' WHEN lower(provider) = 'mistral' THEN CASE WHEN {HEAVY} OR size > 4000 OR n > 30 THEN 'minimal' ELSE 'compact' END
WHEN role IN ('synthesizer', 'extractor') THEN CASE WHEN size > 7000 OR {HEAVY} THEN 'compact' ELSE 'normal' END WHEN {HEAVY} OR n > 45 OR size > 8000 OR tabs > 8 OR profile = 'deep_research' THEN 'compact' ELSE 'normal' END"""


def moded(spark, sf):
    i = F.col("page_id")
    own = table(spark, sf, "pages").withColumn("text", P.body_text(F.col("html")))
    mode = A.context_mode(
        F.when(i % 4 == 0, "openai").when(i % 4 == 1, "Mistral").when(i % 4 == 2, "ollama").otherwise(""), F.when(i % 3 == 0, "navigator").when(i % 3 == 1, "extractor").otherwise("synthesizer"),
        F.when(i % 7 == 0, "www.dropbox.com").otherwise(host_of(F.col("url"))), F.length("text") * 3, i % 60, i % 11, F.when(i % 13 == 0, "deep_research").otherwise("default"), i % 17 == 0, F.when(i % 5 == 0, "x:3b").otherwise("x:70b"))
    return own.withColumn("mode", mode)


@query("p08_context_mode", f"SELECT page_id, {MODE} AS mode FROM {SETTINGS}")
def p08(spark, sf):
    return moded(spark, sf).select("page_id", "mode")


def cap_sql(x: str, field: str) -> str:
    a, b = A.CAPS[field]
    cut = (lambda n: f"list_slice({x}, 1, {n})") if field in ("links", "headings") else (lambda n: f"substr({x}, 1, {n})")
    return f"CASE mode WHEN 'minimal' THEN {cut(a)} WHEN 'compact' THEN {cut(b)} ELSE {x} END"


@query("p10_compacted_pages", f"SELECT m.page_id, mode, {cap_sql('t', 'text')} AS text, {cap_sql('t', 'readable_text')} AS readable_text, array_to_string({cap_sql('l', 'links')}, '|') AS links FROM (SELECT page_id, {MODE} AS mode FROM {SETTINGS}) m JOIN (SELECT page_id, {BODY} AS t FROM pages) b USING (page_id) LEFT JOIN (SELECT page_id, list(substr(text, 1, 60) ORDER BY pos) AS l FROM {LINKS} GROUP BY page_id) k USING (page_id)")
def p10(spark, sf):
    own = moded(spark, sf)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.substring(x["text"], 1, 60))
    links = P.links(table(spark, sf, "pages")).groupBy("page_id").agg(texts.alias("links"))
    own = own.join(links, "page_id", "left")
    mode = F.col("mode")
    return own.select("page_id", "mode", A.capped(F.col("text"), "text", mode).alias("text"), A.capped(F.col("text"), "readable_text", mode).alias("readable_text"), F.array_join(A.capped(F.col("links"), "links", mode), "|").alias("links"))


#: The parts of a page that lie in lists, made of its links four times over, in the page's mode.
PARTS = f"""(SELECT m.page_id, mode, l, CASE mode WHEN 'minimal' THEN 1 WHEN 'compact' THEN 2 END AS g FROM (SELECT page_id, {MODE} AS mode FROM {SETTINGS}) m LEFT JOIN (SELECT page_id, list_concat(l, l, l, l) AS l FROM (SELECT page_id, list({{'t': text, 'h': href}} ORDER BY pos) AS l FROM {LINKS} GROUP BY page_id)) k USING (page_id))"""


def part_sql(name: str, each: str) -> str:
    least, more = A.CAPS[name]
    return f"array_to_string(list_transform(coalesce(list_slice(l, 1, [{least}, {more}, len(l)][coalesce(g, 3)]), []), lambda x, i: {each}), chr(10))"


def field_sql(x: str, part: str, field: str) -> str:
    least, more = A.FIELD_CAPS[part][field]
    return f"substr({x}, 1, [{least}, {more}, 100000][coalesce(g, 3)])"


@query("p10_compacted_parts", f"""SELECT page_id, mode, {part_sql('tables', "x.t || '|' || x.h")} AS tables, {part_sql('inputs', f"'text|' || {field_sql('(x.t || x.h)', 'inputs', 'name')}")} AS inputs,
{part_sql('anchors', f"i || '|' || {field_sql('(x.t || x.h)', 'anchors', 'label')} || CASE mode WHEN 'minimal' THEN '' ELSE '|' || length(x.t) END")} AS anchors,
{part_sql('selectors', f"'nx-' || i || '|' || {field_sql('x.t', 'selectors', 'text')} || '|' || {field_sql('(x.t || x.h)', 'selectors', 'ax_name')} || '|' || {field_sql('x.h', 'selectors', 'dom_path')}")} AS selectors,
{part_sql('tabs', f"{field_sql('(x.t || x.h)', 'tabs', 'title')} || '|' || {field_sql('x.h', 'tabs', 'url')}")} AS tabs,
{part_sql('clickables', f"{field_sql('x.h', 'clickables', 'text')} || '|' || CASE mode WHEN 'normal' THEN '' ELSE {field_sql('x.h', 'clickables', 'label')} END")} AS clickables FROM {PARTS}""")
def p10_parts(spark, sf):
    item = F.struct(F.col("text").alias("t"), F.col("href").alias("h"))
    own = P.links(table(spark, sf, "pages")).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("l")))).alias("l"))
    own = moded(spark, sf).select("page_id", "mode").join(own, "page_id", "left").withColumn("l", F.flatten(F.array_repeat(F.transform("l", lambda x: x["l"]), 4)))

    def of(make) -> Column:
        return F.transform("l", make)

    both = lambda x: F.concat(x["t"], x["h"])
    uid = lambda i: F.concat(F.lit("nx-"), (i + 1).cast("string"))
    own = own.select(
        "page_id", "mode",
        of(lambda x: F.array(F.array(x["t"], x["h"]))).alias("tables"),
        of(lambda x: F.struct(F.lit("text").alias("type"), both(x).alias("name"), F.lit("").alias("selector"))).alias("inputs"),
        of(lambda x, i: F.struct((i + 1).alias("badge"), both(x).alias("label"), F.length(x["t"]).alias("center"))).alias("anchors"),
        of(lambda x, i: F.struct(uid(i).alias("uid"), x["t"].alias("text"), both(x).alias("ax_name"), x["h"].alias("dom_path"))).alias("selectors"),
        of(lambda x: F.struct(both(x).alias("title"), x["h"].alias("url"))).alias("tabs"),
        of(lambda x: F.struct(x["h"].alias("text"), F.lit("").alias("label"))).alias("clickables"),
    )
    got = A.compacted_page(own)

    def lines(name: str, *fields: str) -> Column:
        each = F.transform(name, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields]))
        return F.coalesce(F.array_join(each, "\n"), F.lit("")).alias(name)

    tables = F.coalesce(F.array_join(F.transform("tables", lambda t: F.array_join(t[0], "|")), "\n"), F.lit("")).alias("tables")
    return got.select("page_id", "mode", tables, lines("inputs", "type", "name"), lines("anchors", "badge", "label", "center"), lines("selectors", "uid", "text", "ax_name", "dom_path"), lines("tabs", "title", "url"), lines("clickables", "text", "label"))


#: Conversations as plans: a turn is a step; states come from the conversation's and the turn's number.
PLANS = "SELECT conv_id AS plan_id, turn AS pos, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS text, CASE WHEN conv_id % 3 = 0 THEN 'done' WHEN conv_id % 3 = 1 THEN CASE turn % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'pending' ELSE 'odd' END END AS status FROM conversations"
STATE = "CASE WHEN status IN ('pending', 'current', 'done', 'skipped') THEN status WHEN pos = 0 THEN 'current' ELSE 'pending' END"
PLANNED = f"SELECT plan_id, pos, coalesce(nullif(text, ''), 'Step ' || (pos + 1)) AS text, CASE WHEN NOT max(s = 'current') OVER (PARTITION BY plan_id) AND pos = min(CASE WHEN s = 'pending' THEN pos END) OVER (PARTITION BY plan_id) THEN 'current' ELSE s END AS status FROM (SELECT *, {STATE} AS s FROM ({PLANS}))"


def planned(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    return A.normalized_plan(spark.sql(PLANS.replace("FROM conversations", "FROM conversations_in")))


@query("p11_normalized_plan", PLANNED)
def p11(spark, sf):
    return planned(spark, sf).select("plan_id", "pos", "text", "status")


ADVANCED = f"""SELECT plan_id, pos, CASE WHEN plan_id % 4 = 3 THEN status WHEN pos < goal AND status IN ('pending', 'current') THEN 'done' WHEN pos = goal THEN 'current' WHEN pos > goal AND status = 'current' THEN 'pending' ELSE status END AS status
FROM (SELECT *, greatest(0, least(plan_id % 4 * 2 - 1, count(*) OVER (PARTITION BY plan_id) - 1)) AS goal FROM ({PLANNED}))"""


def advanced(spark, sf):
    from pyspark.sql import Window

    size = F.count("*").over(Window.partitionBy("plan_id"))
    wanted = F.when(F.col("plan_id") % 4 != 3, F.col("plan_id") % 4 * 2 - 1)
    return planned(spark, sf).withColumn("size", size).select("plan_id", "pos", A.advanced(F.col("status"), F.col("pos"), F.col("size"), wanted).alias("status"))


@query("p12_plan_progress", ADVANCED)
def p12(spark, sf):
    return advanced(spark, sf)


@query("w11_current_step", f"SELECT plan_id, min(pos) AS pos FROM ({ADVANCED}) WHERE status = 'current' GROUP BY plan_id")
def w11(spark, sf):
    return advanced(spark, sf).where("status = 'current'").groupBy("plan_id").agg(F.min("pos").alias("pos"))


ACTION = "SELECT event_id, CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'type' WHEN 'purchase' THEN 'search' ELSE 'extract' END AS type, props AS selector, 'https://a.org/' || event_id AS url FROM events"


def actions(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events_in")
    return spark.sql(ACTION.replace("FROM events", "FROM events_in"))


@query("p19_checkpoints", f"SELECT event_id, type IN ('navigate', 'new_tab', 'click', 'search', 'type', 'fill', 'submit') AS verify, CASE WHEN type IN ('navigate', 'new_tab') THEN 'before_navigate' WHEN type = 'click' THEN 'before_click' END AS checkpoint FROM ({ACTION})")
def p19(spark, sf):
    return actions(spark, sf).select("event_id", F.col("type").isin(*A.VERIFIED).alias("verify"), A.checkpoint(F.col("type")).alias("checkpoint"))


@query("p20_action_descriptions", f"""SELECT event_id, CASE type WHEN 'navigate' THEN 'Navigate → ' || url WHEN 'click' THEN 'Click "' || selector || '"' WHEN 'type' THEN 'Type "' || substr(url, 1, 40) || '" into ' || selector WHEN 'search' THEN 'Search "' || url || '"' ELSE type END AS line FROM ({ACTION})""")
def p20(spark, sf):
    url = F.col("url")
    return actions(spark, sf).select("event_id", A.description(F.col("type"), F.col("selector"), url, url, url).alias("line"))


@query("f10_send_clicks", f"SELECT event_id FROM ({ACTION}) WHERE type = 'click' AND regexp_matches(lower(selector), '\\b(send|k\": 1\\d)\\b')")
def f10(spark, sf):
    return actions(spark, sf).where((F.col("type") == "click") & F.lower("selector").rlike(r'\b(send|k": 1\d)\b')).select("event_id")


KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.STEP_KINDS.items())
STEPS = "SELECT event_id, CASE event_type WHEN 'view' THEN 'thinking' WHEN 'click' THEN 'action' WHEN 'signup' THEN 'executing' WHEN 'error' THEN 'error' ELSE 'muted' END AS type, CASE event_id % 3 WHEN 0 THEN '🔍 ' WHEN 1 THEN '✅' ELSE '' END || props AS text FROM events"


@query("p28_step_display", f"SELECT event_id, CASE type {KINDS} ELSE 'bullet' END AS kind, trim(regexp_replace(text, '^[\\x{{1F300}}-\\x{{1FFFF}}\\x{{2600}}-\\x{{27FF}}]\\x{{FE0F}}?\\s*', '')) AS text FROM ({STEPS})")
def p28(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events_in")
    return spark.sql(STEPS.replace("FROM events", "FROM events_in")).select("event_id", A.display_kind(F.col("type")).alias("kind"), T.without_leading_symbol(F.col("text")).alias("text"))


PROFILES = """SELECT event_id AS i, CASE event_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN 'shopping' WHEN 2 THEN '' WHEN 3 THEN event_type ELSE NULL END AS explicit, CASE event_type WHEN 'view' THEN 'builtin_summarise' WHEN 'click' THEN 'x,BUILTIN_RESEARCH_DEEP' WHEN 'error' THEN 'builtin_research_deep,y' WHEN 'signup' THEN 'z,builtin_multi_source' ELSE 'x' END AS ids FROM events"""


@query("p23_task_profile", f"SELECT i, CASE WHEN coalesce(explicit, '') NOT IN ('', 'default') THEN explicit WHEN list_contains(l, 'builtin_summarise') THEN 'summarize' WHEN list_contains(l, 'builtin_research_deep') OR list_contains(l, 'builtin_multi_source') THEN 'deep_research' ELSE 'default' END AS profile FROM (SELECT *, string_split(lower(ids), ',') AS l FROM ({PROFILES}))")
def p23(spark, sf):
    return derived(spark, sf, PROFILES).select("i", A.task_profile(F.col("explicit"), F.split("ids", ",")).alias("profile"))


PROVIDERS = """SELECT p_partkey AS i, CASE p_partkey % 10 WHEN 0 THEN 'openai' WHEN 1 THEN 'groq' WHEN 2 THEN 'mistral' WHEN 3 THEN 'Ollama' WHEN 4 THEN 'kimi' WHEN 5 THEN 'glm' WHEN 6 THEN 'custom' WHEN 7 THEN '' WHEN 8 THEN NULL ELSE 'other' END AS provider, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || '-vision' WHEN 2 THEN 'pixtral-' || p_size ELSE p_name END AS model, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'llava' ELSE lower(p_brand) END AS vision_model, p_size > 25 AS custom FROM part"""


@query("p24_provider_vision", f"""SELECT i, CASE WHEN p IN ('openai', 'anthropic', 'gemini') THEN true WHEN p = 'mistral' THEN {says_sql("coalesce(nullif(model, ''), 'mistral-small-2506')", A.MISTRAL_VISION)}
WHEN p = 'ollama' THEN {says_sql("coalesce(nullif(vision_model, ''), nullif(model, ''), 'llava:7b')", A.LOCAL_VISION)} WHEN p = 'kimi' THEN {says_sql("coalesce(nullif(model, ''), 'kimi-k2.5')", A.MODEL_VISION)}
WHEN p = 'glm' THEN {says_sql("coalesce(nullif(model, ''), 'glm-4.7')", A.MODEL_VISION)} WHEN p = 'custom' THEN custom OR {says_sql('model', A.MODEL_VISION)} ELSE false END AS vision FROM (SELECT *, lower(coalesce(nullif(provider, ''), 'openai')) AS p FROM ({PROVIDERS}))""")
def p24(spark, sf):
    return derived(spark, sf, PROVIDERS).select("i", A.provider_vision(F.col("provider"), F.col("model"), F.lit(""), F.col("vision_model"), F.col("custom")).alias("vision"))
