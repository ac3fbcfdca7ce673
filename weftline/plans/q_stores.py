"""Stores and usage. Conversation turns stand for model calls: the role's model, text length as tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import skills as SK
from ..operators import stores as S
from . import duck as D
from .registry import derived, query, table

USAGE = "SELECT CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'gemini-1.5-pro' ELSE 'unknown-model' END AS model, length(text)::BIGINT AS prompt_tokens, (turn * 10)::BIGINT AS completion_tokens, conv_id, turn FROM conversations"
PRICES = D.rows("model, pp, cp", *[f"('{m}', {a!r}e0, {b!r}e0)" for m, a, b in S.PRICING])


def usage(spark, sf):
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "gemini-1.5-pro").otherwise("unknown-model")
    return table(spark, sf, "conversations").select(model.alias("model"), F.length("text").cast("bigint").alias("prompt_tokens"), (F.col("turn") * 10).cast("bigint").alias("completion_tokens"), "conv_id", "turn")


@query("g01_call_cost", f"SELECT conv_id, turn, round(prompt_tokens / 1e6 * coalesce(pp, 0) + completion_tokens / 1e6 * coalesce(cp, 0), 9) AS cost FROM ({USAGE}) LEFT JOIN ({PRICES}) USING (model)")
def g01(spark, sf):
    return S.priced(usage(spark, sf), S.pricing(spark)).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


@query("j06_pricing_join", f"SELECT conv_id, turn, coalesce(pp, 0) AS prompt_price FROM ({USAGE}) LEFT JOIN ({PRICES}) USING (model)")
def j06(spark, sf):
    return S.priced(usage(spark, sf), S.pricing(spark)).select("conv_id", "turn", F.coalesce("prompt_price", F.lit(0.0)).alias("prompt_price"))


BY_MODEL = f"SELECT model, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens, round(prompt_tokens / 1e6 * coalesce(pp, 0) + completion_tokens / 1e6 * coalesce(cp, 0), 6) AS cost FROM (SELECT model, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM ({USAGE}) GROUP BY model) LEFT JOIN ({PRICES}) USING (model)"


@query("g02_usage_by_model", BY_MODEL)
def g02(spark, sf):
    return S.usage_by_model(usage(spark, sf), S.pricing(spark)).withColumn("cost", F.round("cost", 6))


@query("k17_usage_store", BY_MODEL.replace("GROUP BY model)", "GROUP BY model HAVING sum(prompt_tokens) > 0)"))
def k17(spark, sf):
    return S.usage_by_model(usage(spark, sf), S.pricing(spark)).where("prompt_tokens > 0").withColumn("cost", F.round("cost", 6))


@query("g03_usage_totals", f"SELECT coalesce(model, 'all') AS model, sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost), 6) AS cost FROM ({BY_MODEL.replace('round(prompt_tokens', '(prompt_tokens').replace(', 6) AS cost', ') AS cost')}) WHERE model <> 'total' GROUP BY ROLLUP (model)")
def g03(spark, sf):
    own = S.usage_by_model(usage(spark, sf), S.pricing(spark)).where("model <> 'total'")
    return own.rollup("model").agg(F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("cost"), 6).alias("cost")).select(F.coalesce("model", F.lit("all")).alias("model"), "total_tokens", "cost")


SKILL_ROWS = D.rows("id, category, pos", *[f"({D.lit(s[0])}, {D.lit(s[3])}, {i})" for i, s in enumerate(SK.BUILT_IN)]) + " UNION ALL SELECT 'u' || p_partkey, CASE p_size % 6 WHEN 0 THEN 'Odd' WHEN 1 THEN '' ELSE p_brand END, p_partkey + 5 FROM part"
RANKS = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(SK.CATEGORIES))


@query("g04_skills_by_category", f"SELECT category, string_agg(id, ',' ORDER BY pos) AS ids, row_number() OVER (ORDER BY CASE category {RANKS} ELSE 99 END, min(pos)) AS place FROM (SELECT id, pos, coalesce(nullif(category, ''), 'Custom') AS category FROM ({SKILL_ROWS})) GROUP BY category")
def g04(spark, sf):
    own = derived(spark, sf, SKILL_ROWS).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("Custom")))
    rank = F.coalesce(F.create_map(*[x for i, c in enumerate(SK.CATEGORIES) for x in (F.lit(c), F.lit(i))])[F.col("category")], F.lit(99))
    groups = own.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("l"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.orderBy(rank, "first"))  # one row a category
    return groups.select("category", F.array_join(F.transform("l", lambda x: x["id"]), ",").alias("ids"), place.cast("bigint").alias("place"))


@query("k15_history", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def k15(spark, sf):
    return S.newest(table(spark, sf, "events"), S.HISTORY, [F.desc("ts"), F.desc("event_id")]).select("event_id", F.col("place").cast("bigint").alias("place"))


@query("k16_export_log", "SELECT user_id, event_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 40")
def k16(spark, sf):
    return S.newest(table(spark, sf, "events"), S.EXPORTS, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


STORED = "SELECT 'p' || p_partkey AS id, p_name AS name, p_partkey AS pos FROM part WHERE p_partkey % 3 > 0"
CHANGES = "SELECT 'p' || p_partkey AS id, p_name || ' 2' AS name, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'p' || p_partkey, upper(p_name), p_partkey + 1000000000 FROM part WHERE p_partkey % 8 = 0"


@query("k18_skill_upsert", f"""WITH s AS ({STORED}), c AS ({CHANGES}), l AS (SELECT id, arg_max(name, pos) AS name, min(pos) AS first FROM c GROUP BY id)
SELECT id, name, pos::BIGINT AS place FROM s WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT l.id, l.name, coalesce(s.pos, -l.first - 1)::BIGINT FROM l LEFT JOIN s USING (id)""")
def k18(spark, sf):
    return S.upserted(derived(spark, sf, STORED), derived(spark, sf, CHANGES))


@query("k18b_skill_delete", f"SELECT id, name FROM ({STORED}) WHERE id <> 'p7'")
def k18b(spark, sf):
    return derived(spark, sf, STORED).where("id <> 'p7'").select("id", "name")


SETTINGS_KEPT = "SELECT 'k' || c_custkey AS key, CASE c_nationkey % 4 WHEN 0 THEN NULL ELSE c_name END AS value FROM customer WHERE c_custkey % 3 > 0"
SETTINGS_USUAL = "SELECT 'k' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0"


@query("k19_settings_merge", f"SELECT key AS k, coalesce(n.value, o.value) AS v FROM ({SETTINGS_KEPT}) o FULL JOIN ({SETTINGS_USUAL}) n USING (key)")
def k19(spark, sf):
    old, new = derived(spark, sf, SETTINGS_KEPT), derived(spark, sf, SETTINGS_USUAL).withColumnRenamed("value", "new")
    return old.join(new, "key", "full").select(F.col("key").alias("k"), F.coalesce("new", "value").alias("v"))


@query("u03_set_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 49 AND user_id % 2 = 0")
def u03(spark, sf):
    own = table(spark, sf, "events")
    gone = own.where("event_type = 'error' and value > 49 and user_id % 2 = 0").select("user_id")
    return own.where("event_type = 'view'").select("user_id").distinct().join(gone, "user_id", "left_anti")


@query("u05_host_union", f"SELECT {D.host_of('url')} AS host FROM pages WHERE page_id % 2 = 0 UNION SELECT {D.host_of('url')} FROM pages WHERE page_id % 3 = 0")
def u05(spark, sf):
    from ..functions.urls import host_of

    own = table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    return own.where("page_id % 2 = 0").select("host").union(own.where("page_id % 3 = 0").select("host")).distinct()


@query("g12_distinct_attempts", "SELECT count(*) AS n, count(DISTINCT props) AS attempts FROM events")
def g12(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_distinct("props").alias("attempts"))


@query("g13_last_wins_map", "SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def g13(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"))


MODELS = "SELECT p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'llava:' || p_size || 'b' WHEN 1 THEN ' ' || lower(p_brand) || ' ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE p_brand || '-Vision' END AS name FROM part"
VISION = "'llava', 'bakllava', 'vision', 'qwen2.5vl', 'qwen2-vl', 'gemma3', 'minicpm-v', 'moondream'"


@query("s08_model_catalogue", f"SELECT name, sees, row_number() OVER (ORDER BY sees DESC, pos) AS place FROM (SELECT n AS name, min(pos) AS pos, len(list_filter([{VISION}], lambda x: contains(lower(n), x))) > 0 AS sees FROM (SELECT pos, trim(name) AS n FROM ({MODELS})) WHERE coalesce(n, '') <> '' GROUP BY n)")
def s08(spark, sf):
    own = derived(spark, sf, MODELS).withColumn("name", F.trim("name")).where("coalesce(name, '') <> ''").groupBy("name").agg(F.min("pos").alias("pos"))
    sees = F.exists(F.array(*[F.lit(x.strip(" '")) for x in VISION.split(",")]), lambda x: F.contains(F.lower("name"), x))
    own = own.withColumn("sees", sees)
    return own.select("name", "sees", F.row_number().over(Window.orderBy(F.desc("sees"), "pos")).cast("bigint").alias("place"))


@query("s09_settings", f"SELECT key, value FROM ({SETTINGS_KEPT}) UNION ALL SELECT key, value FROM ({SETTINGS_USUAL}) WHERE key NOT IN (SELECT key FROM ({SETTINGS_KEPT}))")
def s09(spark, sf):
    return S.with_defaults(derived(spark, sf, SETTINGS_KEPT), derived(spark, sf, SETTINGS_USUAL))


SERVICE_KEYS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' END AS tavily, CASE c_nationkey % 3 WHEN 0 THEN c_name END AS langsearch, CASE c_nationkey % 5 WHEN 0 THEN 'b' ELSE '' END AS brave, CASE c_custkey % 7 WHEN 0 THEN NULL ELSE c_mktsegment END AS serper FROM customer"


@query("s07_search_service", f"SELECT id, CASE WHEN coalesce(tavily, '') <> '' THEN 'tavily' WHEN coalesce(langsearch, '') <> '' THEN 'langsearch' WHEN coalesce(brave, '') <> '' THEN 'brave' WHEN coalesce(serper, '') <> '' THEN 'serper' END AS service FROM ({SERVICE_KEYS})")
def s07(spark, sf):
    return derived(spark, sf, SERVICE_KEYS).select("id", S.search_service({k: F.col(k) for k in S.SEARCH_SERVICES}).alias("service"))
