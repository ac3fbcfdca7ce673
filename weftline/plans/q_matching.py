"""Joins: snapshots, targets, skills, sites and checklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import elements as E
from ..operators import pages as P
from ..operators import skills as S
from . import duck as D
from .q_pages import LINKS
from .registry import derived, query, table


def link_elements(spark, sf):
    return P.links(table(spark, sf, "pages")).withColumns({"role": F.lit("link"), "tag": F.lit("a")})


KEY = f"substr('link|a' || coalesce('|' || nullif(lower({D.normalize('text')}), ''), '') || coalesce('|' || nullif(substr(lower(trim(href)), 1, 180), ''), ''), 1, 420)"
LABEL = f"substr({D.normalize('text')}, 1, 160)"
MATCH = f"substr({D.normalize(chr(39) + chr(39) + ' || text || ' + chr(39) + ' ' + chr(39) + ' || href')}, 1, 220)"


@query("p01_element_label", f"SELECT page_id, pos::BIGINT AS pos, {LABEL} AS label FROM {LINKS}")
def p01(spark, sf):
    return E.complete(link_elements(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), E.label().alias("label"))


@query("p02_stable_key", f"SELECT page_id, pos::BIGINT AS pos, {KEY} AS stable_key FROM {LINKS}")
def p02(spark, sf):
    return E.complete(link_elements(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), E.stable_key().alias("stable_key"))


@query("p03_match_text", f"SELECT page_id, pos::BIGINT AS pos, {MATCH} AS match_text FROM {LINKS}")
def p03(spark, sf):
    return E.complete(link_elements(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), E.match_text().alias("match_text"))


@query("x28_ax_name", f"SELECT page_id, pos::BIGINT AS pos, {LABEL} AS ax_name FROM {LINKS}")
def x28(spark, sf):
    own = E.complete(link_elements(spark, sf)).withColumn("own", E.label())
    return own.select("page_id", F.col("pos").cast("bigint").alias("pos"), E.ax_name(F.col("own")).alias("ax_name"))


#: The previous snapshot lacks every third link; one page in five had another URL, one in seven has none.
BEFORE = f"(SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '#old' ELSE url END AS url, text, href FROM {LINKS} WHERE pos % 3 <> 0 AND page_id % 7 <> 0)"
NEW = f"""SELECT c.page_id, c.pos::BIGINT AS pos, coalesce(p.url = c.url AND k.stable_key IS NULL, false) AS is_new FROM (SELECT page_id, url, pos, {KEY} AS stable_key FROM {LINKS}) c
LEFT JOIN (SELECT DISTINCT page_id, url FROM {BEFORE}) p USING (page_id) LEFT JOIN (SELECT DISTINCT page_id, {KEY} AS stable_key FROM {BEFORE}) k ON k.page_id = c.page_id AND k.stable_key = c.stable_key"""


def with_news(spark, sf):
    own = link_elements(spark, sf)
    before = own.where("pos % 3 <> 0 and page_id % 7 <> 0").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("#old"))).otherwise(F.col("url")))
    return E.enrich(own, before)


@query("j01_new_elements", NEW)
def j01(spark, sf):
    return with_news(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), "is_new")


@query("g05_page_insights", f"SELECT page_id, count(*) AS n, count(*) FILTER (is_new) AS n_new FROM ({NEW}) GROUP BY page_id")
def g05(spark, sf):
    return with_news(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))


@query("p04_enriched_elements", f"SELECT l.page_id, l.pos::BIGINT AS pos, 'nx-' || l.pos AS uid, {LABEL.replace('text', 'l.text')} AS label, {D.host_of('l.href')} AS link_host, n.is_new FROM {LINKS} l JOIN ({NEW}) n ON l.page_id = n.page_id AND l.pos = n.pos")
def p04(spark, sf):
    return with_news(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), "uid", F.col("own_label").alias("label"), "link_host", "is_new")


@query("p07_page_signature", f"SELECT page_id, sha256(string_agg(k || '|' || lab || '|' || CASE WHEN is_new THEN 'new' ELSE 'seen' END, chr(10) ORDER BY pos)) AS signature FROM (SELECT l.page_id, l.pos, {KEY} AS k, {LABEL} AS lab, n.is_new FROM {LINKS} l JOIN ({NEW}) n ON l.page_id = n.page_id AND l.pos = n.pos WHERE l.pos <= 12) GROUP BY page_id")
def p07(spark, sf):
    part = F.concat_ws("|", "stable_key", "own_label", F.when(F.col("is_new"), "new").otherwise("seen"))
    own = with_news(spark, sf).where("pos <= 12").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("l"))
    return own.select("page_id", F.sha2(F.array_join(F.transform("l", lambda x: x["part"]), "\n"), 256).alias("signature"))


BOUNDS = "SELECT page, pos, o_orderkey % 50 - 10 AS x, o_custkey % 90 - 20 AS y, o_orderkey % 30 * 30 - 30 AS w, o_orderkey % 7 * 45 AS h FROM (SELECT *, CAST(floor(o_custkey / 10) AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY floor(o_custkey / 10) ORDER BY o_orderkey) AS BIGINT) AS pos FROM orders)"


@query("p05_screenshot_anchors", f"SELECT page, pos, n, floor(x + w / 2.0e0 + 0.5e0)::BIGINT AS cx, floor(y + h / 2.0e0 + 0.5e0)::BIGINT AS cy FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM ({BOUNDS}) WHERE w > 0 AND h > 0) WHERE n <= 24")
def p05(spark, sf):
    from pyspark.sql import Window

    own = derived(spark, sf, BOUNDS).where("w > 0 and h > 0").withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("pos")).cast("bigint")).where("n <= 24")

    def centre(a, size):
        return F.floor(F.col(a) + F.col(size) / 2.0 + 0.5).cast("bigint")

    return own.select("page", "pos", "n", centre("x", "w").alias("cx"), centre("y", "h").alias("cy"))


@query("p06_overlay_items", f"SELECT page, pos FROM ({BOUNDS}) WHERE pos <= 48 AND w > 0 AND h > 0")
def p06(spark, sf):
    return derived(spark, sf, BOUNDS).where("pos <= 48").where("w > 0 and h > 0").select("page", "pos")


@query("x11_size_boost", f"SELECT page, pos, round(0.5e0 + CASE WHEN w * h > 1000 AND w * h < 200000 THEN 0.03e0 ELSE 0 END, 6) AS score FROM ({BOUNDS})")
def x11(spark, sf):
    return derived(spark, sf, BOUNDS).select("page", "pos", F.round(E.boosted(F.lit(0.5), F.col("w"), F.col("h")), 6).alias("score"))


#: Each page's action names its second link by text; the target is matched against all links of the page.
TARGET = f"(SELECT page_id, {D.for_matching('text', True)} AS target FROM {LINKS} WHERE pos = 2)"
SCORES = f"""SELECT page_id, pos, CASE WHEN target = '' THEN 0.0e0 WHEN t <> '' AND (contains(t, target) OR contains(target, t)) THEN {D.length_ratio('target', 't')} + 0.32e0
ELSE greatest({D.overlap_of_first(D.words('target'), D.words('t'))}, {D.overlap_of_first(D.words('target'), D.words('h'))} * 0.75e0) + 0.08e0 END AS score
FROM (SELECT l.page_id, l.pos, g.target, {D.for_matching('l.text', True)} AS t, {D.for_matching('l.href', True)} AS h FROM {LINKS} l JOIN {TARGET} g USING (page_id))"""


def scored_links(spark, sf):
    own = link_elements(spark, sf)
    g = own.where("pos = 2").select("page_id", T.for_matching(F.col("text"), True).alias("target"))
    both = own.join(g, "page_id")
    return both.withColumn("score", E.target_score(F.col("target"), {c: F.col(c) for c in ("text", "href", "role", "tag")}))


@query("x10_target_score", f"SELECT page_id, pos::BIGINT AS pos, round(score, 6) AS score FROM ({SCORES})")
def x10(spark, sf):
    return scored_links(spark, sf).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


@query("t05_best_target", f"SELECT page_id, pos::BIGINT AS pos, round(score, 6) AS score FROM ({SCORES}) WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1")
def t05(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return scored_links(spark, sf).where("score >= 0.34").withColumn("n", F.row_number().over(w)).where("n = 1").select("page_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


#: Actions by uid (page 0 mod 4), by selector (1), by text (2) and by a text that only resembles (3).
ACTIONS = "SELECT page_id AS action_id, page_id, CASE WHEN page_id % 4 = 0 THEN 'uid:nx-3' ELSE '' END AS uid, CASE WHEN page_id % 4 = 1 THEN 'uid:nx-2' ELSE '' END AS selector, CASE WHEN page_id % 4 = 2 THEN upper(text) WHEN page_id % 4 = 3 THEN text || ' now' ELSE '' END AS wanted FROM"
J09 = f"""WITH a AS ({ACTIONS} {LINKS} WHERE pos = 2), e AS (SELECT page_id, pos, text, href FROM {LINKS}),
b AS (SELECT a.action_id, a.page_id, e.pos, regexp_replace(coalesce(nullif(uid, ''), selector), '^uid:', '') AS u, selector, lower(trim(coalesce(nullif(wanted, ''), regexp_replace(selector, '^text:', '')))) AS said, e.text, e.href FROM a JOIN e USING (page_id)),
n AS (SELECT *, {D.for_matching('said', True)} AS target, {D.for_matching('text', True)} AS t, {D.for_matching('href', True)} AS h FROM b),
s AS (SELECT *, CASE WHEN target = '' THEN 0.0e0 WHEN t <> '' AND (contains(t, target) OR contains(target, t)) THEN {D.length_ratio('target', 't')} + 0.32e0 ELSE greatest({D.overlap_of_first(D.words('target'), D.words('t'))}, {D.overlap_of_first(D.words('target'), D.words('h'))} * 0.75e0) + 0.08e0 END AS score FROM n),
r AS (SELECT *, CASE WHEN u <> '' AND u = 'nx-' || pos THEN 1 WHEN selector <> '' AND selector = 'uid:nx-' || pos THEN 2 WHEN said <> '' AND lower(trim(text)) = said THEN 3 WHEN said <> '' AND score >= 0.34 THEN 6 END AS tier FROM s)
SELECT action_id, page_id, pos::BIGINT AS pos, tier::BIGINT AS tier FROM r WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY tier, CASE WHEN tier = 6 THEN -score ELSE 0 END, pos) = 1"""


@query("j09_action_target", J09)
def j09(spark, sf):
    own = link_elements(spark, sf).withColumn("uid", F.concat(F.lit("nx-"), F.col("pos").cast("string")))
    i = F.col("page_id") % 4
    a = own.where("pos = 2").select(F.col("page_id").alias("action_id"), "page_id", F.when(i == 0, "uid:nx-3").otherwise("").alias("uid"), F.when(i == 1, "uid:nx-2").otherwise("").alias("selector"), F.when(i == 2, F.upper("text")).when(i == 3, F.concat("text", F.lit(" now"))).otherwise("").alias("wanted"))
    return E.match_targets(a, own).select("action_id", "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("tier").cast("bigint").alias("tier"))


@query("j02_uid_lookup", f"SELECT u.page_id, u.k::BIGINT AS k, l.text FROM (SELECT page_id, k, CASE WHEN k % 2 = 0 THEN 'uid:nx-' || k ELSE 'nx-' || (k + 3) END AS uid FROM (SELECT DISTINCT page_id FROM {LINKS}), (SELECT unnest(range(1, 6)) AS k)) u JOIN {LINKS} l ON l.page_id = u.page_id AND 'nx-' || l.pos = regexp_replace(u.uid, '^uid:', '')")
def j02(spark, sf):
    own = link_elements(spark, sf)
    u = own.select("page_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("uid", F.when(F.col("k") % 2 == 0, F.concat(F.lit("uid:nx-"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("nx-"), (F.col("k") + 3).cast("string"))))
    keyed = own.withColumn("key", F.concat(F.lit("nx-"), F.col("pos").cast("string")))
    return u.withColumn("key", F.regexp_replace("uid", "^uid:", "")).join(keyed, ["page_id", "key"]).select("page_id", F.col("k").cast("bigint").alias("k"), "text")


@query("j03_right_wins_merge", f"SELECT l.page_id, l.pos::BIGINT AS pos, coalesce(CASE WHEN l.pos % 2 = 0 THEN l.text || '!' END, l.text) AS text FROM {LINKS} l")
def j03(spark, sf):
    own = link_elements(spark, sf)
    right = own.where("pos % 2 = 0").select("page_id", "pos", F.concat("text", F.lit("!")).alias("better"))
    return own.join(right, ["page_id", "pos"], "left").select("page_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("better", "text").alias("text"))


SKILLS = D.rows("id, name, description, hosts, built_in, pos", *[f"({D.lit(s[0])}, {D.lit(s[1])}, {D.lit(s[2])}, {D.lit(','.join(s[4]))}, true, {i})" for i, s in enumerate(S.BUILT_IN)], "('user_vague', 'The onon thing', 'anre the tion of heer', '', false, 5)", "('user_hosts', 'Own site', 'eron', 'example.com, X.example.net', false, 6)")
#: The catalogue and users' own skills, one a part.
MORE_SKILLS = f"{SKILLS} UNION ALL SELECT 'user_' || p_partkey, p_name, p_type, 'a' || p_size || '.com, B' || p_partkey || '.net', false, p_partkey + 100 FROM part"
WORDS_CASE = " ".join(f"WHEN {D.lit(k)} THEN [{', '.join(map(D.lit, v))}]" for k, v in S.KEY_WORDS.items())
TASKS = "SELECT conv_id * 100 + turn AS task_id, CASE conv_id % 4 WHEN 0 THEN 'Please summarize and explain: ' WHEN 1 THEN 'buy cheap, compare price: ' WHEN 2 THEN 'email contact ' ELSE '' END || text AS task, CASE WHEN conv_id % 3 = 0 THEN 'https://www.amazon.in/x' WHEN conv_id % 3 = 1 THEN 'https://m.example.com/' ELSE '' END AS page_url FROM conversations WHERE role = 'user'"
SCORE = f"""(SELECT task_id, id, pos, least(1.0e0, CASE WHEN host <> '' AND len(list_filter(hosts, lambda x: contains(host, x) OR contains(x, host))) > 0 THEN 0.55e0 ELSE 0 END
+ least(0.45e0, len(list_filter(hits, lambda x: contains(n, x))) * 0.14e0) + {D.overlap_of_larger('tw', 'sw')} * 0.30e0 - CASE WHEN NOT built_in AND len(hosts) = 0 AND len(hits) = 0 THEN 0.1e0 ELSE 0 END) AS score
FROM (SELECT task_id, {D.for_matching('task')} AS n, {D.host_of('page_url')} AS host, {D.key_words(D.for_matching('task'))} AS tw FROM ({TASKS})),
(SELECT id, pos, built_in, list_filter(list_transform(string_split(hosts, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS hosts, {D.key_words(D.for_matching("name || ' ' || description"))} AS sw, coalesce(CASE id {WORDS_CASE} END, []::VARCHAR[]) AS hits FROM ({SKILLS})))"""


def tasks_and_skills(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    own = spark.sql(SKILLS.replace("SELECT *", "SELECT id, name, description, hosts, built_in, pos")).withColumns({"allowed_hosts": F.split("hosts", ","), "checklist": F.array().cast("array<string>"), "category": F.lit("Custom")})
    return spark.sql(TASKS.replace("FROM conversations", "FROM conversations_in")), S.cleaned(own)


def more_skills(spark, sf):
    return derived(spark, sf, MORE_SKILLS.replace("SELECT *", "SELECT id, name, description, hosts, built_in, pos")).withColumns({"allowed_hosts": F.split("hosts", ","), "checklist": F.array().cast("array<string>"), "category": F.lit("Custom")})


@query("x12_skill_score", f"SELECT task_id, id, round(score, 6) AS score FROM {SCORE}")
def x12(spark, sf):
    return S.scored(*tasks_and_skills(spark, sf)).select("task_id", "id", F.round("score", 6).alias("score"))


@query("j07_chosen_skills", f"SELECT task_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, pos) AS rank FROM {SCORE} WHERE score >= 0.38e0) WHERE rank <= 2")
def j07(spark, sf):
    return S.chosen(*tasks_and_skills(spark, sf)).select("task_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("t04_top_skill", f"SELECT task_id, id FROM {SCORE} WHERE score >= 0.38e0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, pos) = 1")
def t04(spark, sf):
    return S.chosen(*tasks_and_skills(spark, sf)).where("rank = 1").select("task_id", "id")


#: Skills that are active: those that tasks name.
ACTIVE = "SELECT DISTINCT CASE conv_id % 3 WHEN 0 THEN 'builtin_fill_form' ELSE 'user_' || conv_id END AS id FROM conversations"


@query("j05_inactive_skills", f"SELECT id FROM ({MORE_SKILLS}) WHERE id NOT IN ({ACTIVE})")
def j05(spark, sf):
    return more_skills(spark, sf).join(derived(spark, sf, ACTIVE), "id", "left_anti").select("id")


@query("f11_skill_search", f"SELECT id FROM ({MORE_SKILLS}) WHERE contains(lower(name), 'page') OR contains(lower(name), 'an') OR contains(lower('Custom'), 'page')")
def f11(spark, sf):
    def says(word):
        return F.contains(F.lower("name"), F.lit(word))

    return more_skills(spark, sf).where(says("page") | says("an") | F.contains(F.lower("category"), F.lit("page"))).select("id")


@query("s10_skill_catalogue", f"SELECT id, pos::BIGINT AS pos FROM ({MORE_SKILLS})")
def s10(spark, sf):
    own = more_skills(spark, sf).where("not built_in").withColumn("pos", F.col("pos") - 5)
    return S.catalogue(spark, own.select("id", "name", "description", "category", "allowed_hosts", "checklist", "built_in", "pos")).select("id", F.col("pos").cast("bigint").alias("pos"))


WANTED = "SELECT conv_id * 100 + turn AS k, CASE turn % 3 WHEN 0 THEN 'builtin_fill_form' WHEN 1 THEN 'user_' || conv_id ELSE 'missing' END AS id FROM conversations"


@query("j13_skill_lookup", f"SELECT w.k, s.id, s.name FROM ({WANTED}) w JOIN ({MORE_SKILLS}) s USING (id)")
def j13(spark, sf):
    return derived(spark, sf, WANTED).join(more_skills(spark, sf), "id").select("k", "id", "name")


@query("j11_host_allowed", f"SELECT p.page_id, s.id FROM pages p, ({SKILLS}) s WHERE {D.host_of('p.url')} <> '' AND len(list_filter(list_filter(list_transform(string_split(s.hosts, ','), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: contains({D.host_of('p.url')}, x) OR contains(x, {D.host_of('p.url')}))) > 0")
def j11(spark, sf):
    _, skills = tasks_and_skills(spark, sf)
    host = table(spark, sf, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))
    return host.join(F.broadcast(skills), S.host_allowed(F.col("host"), F.col("allowed_hosts"))).select("page_id", "id")


SITES = " UNION ALL ".join(f"SELECT {i} AS i, '{w}' AS w, '{h}' AS h" for i, (w, h) in enumerate(U.SITE_WORDS))
SITED = "SELECT conv_id, turn, text || CASE conv_id % 5 WHEN 0 THEN ' News on GitHub' WHEN 1 THEN ' from amazon.com and www.imdb.com' WHEN 2 THEN ' medium' ELSE '' END AS task FROM conversations"


@query("j08_site_words", f"SELECT conv_id, turn, string_agg(h, ',' ORDER BY i) AS hosts FROM ({SITED}), ({SITES}) WHERE regexp_matches(lower(task), '\\b' || w || '\\b') GROUP BY conv_id, turn")
def j08(spark, sf):
    own = sited(spark, sf)
    sites = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(U.SITE_WORDS)], "i int, w string, h string")
    hit = own.join(F.broadcast(sites), F.expr(r"lower(task) rlike concat('\\b', w, '\\b')")).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("l"))
    return hit.select("conv_id", "turn", F.array_join(F.transform("l", lambda x: x["h"]), ",").alias("hosts"))


def sited(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    return spark.sql(SITED.replace("FROM conversations", "FROM conversations_in"))


HINTED = f"list_sort(list_distinct(list_filter(list_concat(list_transform(['https://www.a.org/x', 'imdb.com'], lambda x: {D.normalize_host('x')}), list_concat(list_transform(regexp_extract_all(lower(task), {D.lit(T.DOMAIN)}), lambda x: {D.normalize_host('x')}), list_filter([{', '.join(chr(39) + h + chr(39) for _, h in U.SITE_WORDS)}], lambda h: false))), lambda h: h <> '')))"


@query("u02_hint_union", f"SELECT conv_id, turn, array_to_string({HINTED}, '|') AS hosts FROM ({SITED})")
def u02(spark, sf):
    given = F.transform(F.array(F.lit("https://www.a.org/x"), F.lit("imdb.com")), U.normalize_host)
    inline = F.transform(T.domains(F.col("task")), U.normalize_host)
    hosts = F.array_distinct(F.filter(F.concat(given, inline), lambda h: h != ""))
    return sited(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(hosts), "|").alias("hosts"))


@query("p22_targeted_query", f"SELECT conv_id, turn, trim(task) || ' site:a.org site:b.net site:c.io' AS q FROM ({SITED}) WHERE trim(task) <> ''")
def p22(spark, sf):
    hosts = F.array(*[F.lit(h) for h in ("a.org", "b.net", "c.io", "d.com")])
    sites = F.transform(F.slice(hosts, 1, 3), lambda h: F.concat(F.lit("site:"), h))
    return sited(spark, sf).where(F.trim("task") != "").select("conv_id", "turn", F.concat_ws(" ", F.trim("task"), F.array_join(sites, " ")).alias("q"))


REPLIES = "SELECT conv_id % 20 AS session, conv_id * 100 + turn AS pos, CASE turn % 3 WHEN 0 THEN '[DONE: Page fully scrolled] ' WHEN 1 THEN '[done: All emails extracted from it] [DONE: nothing known]' ELSE '' END || role AS text FROM conversations"
KNOWN = ", ".join(f"({D.lit(x)})" for s in S.BUILT_IN for x in s[5])


@query("j10_checklist", f"""WITH m AS (SELECT session, pos, unnest(i) AS item, unnest(range(0, len(i))) AS k FROM (SELECT session, pos, list_filter(list_transform(regexp_extract_all(text, '(?i)\\[DONE:\\s*([^\\]]+)\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS i FROM ({REPLIES})))
SELECT session, pos, item FROM m WHERE EXISTS (SELECT 1 FROM (VALUES {KNOWN}) AS k(v) WHERE contains(lower(v), substr(lower(item), 1, 20))) QUALIFY row_number() OVER (PARTITION BY session, item ORDER BY pos, k) = 1""")
def j10(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("conversations_in")
    return S.checklist_marks(spark.sql(REPLIES.replace("FROM conversations", "FROM conversations_in")), S.catalogue(spark))


@query("p13_clean_skills", f"SELECT id, substr(trim(name), 1, 80) AS name, CASE WHEN pos % 2 = 0 THEN 'Research' ELSE 'Custom' END AS category, array_to_string(list_filter(list_transform(string_split(hosts, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS hosts FROM ({MORE_SKILLS})")
def p13(spark, sf):
    own = more_skills(spark, sf).withColumns({"category": F.when(F.col("pos") % 2 == 0, "Research").otherwise("Odd")})
    return S.cleaned(own).select("id", "name", "category", F.array_join("allowed_hosts", "|").alias("hosts"))


@query("u04_shared_words", f"SELECT conv_id, turn, len(list_intersect({D.words(D.for_matching('task'))}, ['the', 'of', 'news', 'la', 'de']))::BIGINT AS n FROM ({SITED})")
def u04(spark, sf):
    return sited(spark, sf).select("conv_id", "turn", T.shared(T.words(T.for_matching(F.col("task"))), F.array(*map(F.lit, ("the", "of", "news", "la", "de")))).cast("bigint").alias("n"))


@query("f13_search_inputs", f"SELECT page_id, min(pos)::BIGINT AS pos FROM {LINKS} WHERE regexp_matches(lower(text || CASE WHEN page_id % 3 = 0 AND pos > 2 THEN ' find' ELSE '' END || ' link a ' || href), 'search|find|query|lookup|\\b(qs?|search-input|search-field)\\b') GROUP BY page_id")
def f13(spark, sf):
    own = F.when((F.col("page_id") % 3 == 0) & (F.col("pos") > 2), "find")
    hay = F.lower(F.concat_ws(" ", "text", own, "role", "tag", "href"))
    own = link_elements(spark, sf).where(hay.rlike(r"search|find|query|lookup|\b(qs?|search-input|search-field)\b"))
    return own.groupBy("page_id").agg(F.min("pos").cast("bigint").alias("pos"))


@query("s11_tab_snapshot", "SELECT p.page_id AS tab_id, coalesce(CASE WHEN p.page_id % 3 < 2 THEN p.url END, CASE WHEN p.page_id % 2 = 0 THEN p.url || '#cached' END) AS url FROM pages p")
def s11(spark, sf):
    own = table(spark, sf, "pages").select(F.col("page_id").alias("tab_id"), "url")
    live = own.where("tab_id % 3 < 2").select("tab_id", F.col("url").alias("live"))
    cached = own.where("tab_id % 2 = 0").select("tab_id", F.concat("url", F.lit("#cached")).alias("cached"))
    return own.select("tab_id").join(live, "tab_id", "left").join(cached, "tab_id", "left").select("tab_id", F.coalesce("live", "cached").alias("url"))


@query("j15_source_merge", f"SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN 'digest ' || page_id ELSE '' END, ''), nullif(text, ''), url) AS summary FROM (SELECT page_id, url, {D.normalize('url')} AS text FROM pages)")
def j15(spark, sf):
    own = table(spark, sf, "pages").withColumn("text", T.normalize(F.col("url")))
    digest = own.where("page_id % 2 = 0").select("page_id", F.concat(F.lit("digest "), F.col("page_id").cast("string")).alias("digest"))
    return own.join(digest, "page_id", "left").select("page_id", T.first_of(F.col("digest"), F.col("text"), F.col("url")).alias("summary"))


@query("j12_tab_choice", "SELECT t.k, coalesce(max(CASE WHEN p.page_id = t.id THEN p.page_id END), min(CASE WHEN contains(p.url, t.part) THEN p.page_id END)) AS tab_id FROM (VALUES (1, 3, 'zz'), (2, -1, 'page=2'), (3, -1, '/en/')) AS t(k, id, part), pages p GROUP BY t.k")
def j12(spark, sf):
    wanted = spark.createDataFrame([(1, 3, "zz"), (2, -1, "page=2"), (3, -1, "/en/")], "k int, id bigint, part string")
    both = table(spark, sf, "pages").select("page_id", "url").join(F.broadcast(wanted), (F.col("page_id") == F.col("id")) | F.contains("url", "part"))
    return both.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("page_id") == F.col("id"), F.col("page_id"))), F.min("page_id")).alias("tab_id"))


@query("j14_element_lookup", f"SELECT page_id, min(pos)::BIGINT AS pos FROM {LINKS} WHERE pos = 4 OR lower(trim(text)) = 'the' GROUP BY page_id")
def j14(spark, sf):
    own = link_elements(spark, sf).where((F.col("pos") == 4) | (F.lower(F.trim("text")) == "the"))
    return own.groupBy("page_id").agg(F.min("pos").cast("bigint").alias("pos"))


FIELDS_OF_PAGES = """SELECT CAST(floor(event_id / 7) AS BIGINT) AS page_id, event_id % 7 AS pos, CASE event_type WHEN 'view' THEN 'Search' WHEN 'error' THEN NULL ELSE event_type END AS kind,
CASE event_id % 6 WHEN 0 THEN 'text email ' || props WHEN 1 THEN 'Find it' WHEN 2 THEN 'my query' WHEN 3 THEN 'q' WHEN 4 THEN NULL ELSE 'QUERY search' END AS hints, CAST(floor(value * 20) AS INT) AS top, CAST(user_id % 300 AS INT) AS width FROM events"""
POINTS = """(CASE WHEN lower(coalesce(kind, '')) = 'search' THEN 6 ELSE 0 END + CASE WHEN contains(h, 'search') THEN 5 ELSE 0 END + CASE WHEN contains(h, 'find') THEN 4 ELSE 0 END + CASE WHEN contains(h, 'query') THEN 3 ELSE 0 END
+ CASE WHEN regexp_matches(h, '\\bqs?\\b') THEN 3 ELSE 0 END + CASE WHEN top < 1000 * 0.45 THEN 2 ELSE 0 END + CASE WHEN width > 120 THEN 1 ELSE 0 END)"""


@query("t06_search_input", f"SELECT page_id, pos, score FROM (SELECT *, {POINTS} AS score FROM (SELECT *, lower(coalesce(hints, '')) AS h FROM ({FIELDS_OF_PAGES}))) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1")
def t06(spark, sf):
    own = derived(spark, sf, FIELDS_OF_PAGES).withColumn("score", E.search_input_score(F.col("hints"), F.col("kind"), F.col("top"), F.col("width"), F.lit(1000)))
    return E.best_search_input(own).select("page_id", "pos", "score")


MODED = f"(SELECT *, CASE page_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'compact' ELSE 'minimal' END AS mode FROM {LINKS})"


def cut_sql(x: str, field: str) -> str:
    a, b = E.ELEMENT_CAPS[field]
    return f"CASE mode WHEN 'minimal' THEN substr({x}, 1, {a}) WHEN 'compact' THEN substr({x}, 1, {b}) ELSE {x} END"


@query("p10_compacted_elements", f"SELECT page_id, pos::BIGINT AS pos, mode, {cut_sql('text', 'text')} AS text, CASE mode WHEN 'normal' THEN '' ELSE {cut_sql('text', 'label')} END AS label, {cut_sql('href', 'href')} AS href, {cut_sql(KEY, 'stable_key')} AS stable_key FROM {MODED} WHERE mode = 'normal' OR pos <= CASE mode WHEN 'minimal' THEN 18 ELSE 32 END")
def p10_elements(spark, sf):
    k = F.col("page_id") % 3
    own = link_elements(spark, sf).withColumn("mode", F.when(k == 0, "normal").when(k == 1, "compact").otherwise("minimal"))
    return E.compacted(own).select("page_id", F.col("pos").cast("bigint").alias("pos"), "mode", "text", "label", "href", "stable_key")
