"""Prompts, requests, attachments and skill macros over pages, conversations, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import prompts as R
from . import duck as D
from .q_pages import BODY, DIVERSIFIED, HEADS, LINKS, TITLE, t02
from .registry import query, table

NL = "chr(10)"
SKILL = "id string, name string, prompt string, allowed_hosts array<string>, preferred_sites array<string>, checklist array<string>, pos int"
#: A user's skills, as they would be written by hand.
OWN = [
    ("own-digest", "Digest", "Summarise what it says", ["example.org", "example.com"], [], ["done well", "short"], 0), ("own_find", "It's found", "Find it", [], ["a.org", "b.org"], [], 1),
    ("own digest", "Later", "of the same name", [], [], [], 2),
]


def sections_sql(*parts: tuple) -> str:
    out = []
    for title, body, *when in parts:
        text = f"'## {title}' || {NL} || coalesce({body}, '')"
        out.append(f"CASE WHEN {when[0]} THEN {text} END" if when else text)
    return f"concat_ws({NL} || {NL}, {', '.join(out)})"


def lines_sql(items: str, each: str = "x", most: int | None = None, last: bool = False, lead: str = "  • ", empty: str = "  None") -> str:
    own = items if most is None else f"list_slice({items}, greatest(len({items}) - {most - 1}, 1), len({items}))" if last else f"list_slice({items}, 1, {most})"
    return f"CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({own}, lambda x: {D.lit(lead)} || {each}), {NL}) ELSE {D.lit(empty)} END"


def quoted_sql(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def texts_sql(items: str, most: int) -> str:
    return f"CASE WHEN len({items}) > 0 THEN '[' || {NL} || '  ' || array_to_string(list_transform(list_slice({items}, 1, {most}), lambda x: {quoted_sql('x')}), ',' || {NL} || '  ') || {NL} || ']' ELSE '[]' END"


def objects_sql(items: str, keys: tuple[str, ...], most: int) -> str:
    one = f" || ',' || {NL} || ".join(f"""'    "{k}": ' || {quoted_sql(f"x['{k}']")}""" for k in keys)
    return f"CASE WHEN len({items}) > 0 THEN '[' || {NL} || array_to_string(list_transform(list_slice({items}, 1, {most}), lambda x: '  {{' || {NL} || {one} || {NL} || '  }}'), ',' || {NL}) || {NL} || ']' ELSE '[]' END"


PAGES = f"""(SELECT page_id, url, {D.host_of('url')} AS host, {TITLE} AS title, {HEADS} AS heads, {BODY} AS body, l AS links FROM pages LEFT JOIN (SELECT page_id AS k, list({{'text': text, 'href': href}} ORDER BY pos) AS l FROM {LINKS} GROUP BY page_id) ON page_id = k)"""


def page_rows(spark, sf):
    """Pages with their links as an array, and the context of a prompt about them."""
    own = table(spark, sf, "pages")
    links = P.links(own).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "href"))), lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"))).alias("links"))
    return P.fields(own).join(links, "page_id", "left")


#: Two tables of each page's own data.
TABLES = "[[[title, page_id::VARCHAR], ['links', coalesce(len(links), 0)::VARCHAR]], [[host]]]"


def page_context(**more) -> R.Context:
    pid, s = F.col("page_id").cast("string"), F.array
    size = F.when(F.size("links") > 0, F.size("links")).otherwise(0).cast("string")
    tables = s(s(s(F.col("title"), pid), s(F.lit("links"), size)), s(s(F.col("host"))))
    return R.Context(**({"task": F.concat(F.lit("Read page "), pid), "url": F.col("url"), "title": F.col("title"), "text": F.col("text"), "headings": F.col("headings"), "tables": tables, "links": F.col("links")} | more))


TABLE_TEXT = f"'Table 1:' || {NL} || title || ' | ' || page_id || {NL} || 'links | ' || coalesce(len(links), 0) || {NL} || {NL} || 'Table 2:' || {NL} || host"
SOURCE = f"'Source ' || (page_id % 3 + 1) || ' of 3' || {NL} || 'Title: ' || coalesce(nullif(title, ''), 'Untitled') || {NL} || 'URL: ' || url || {NL} || 'Host: ' || host"


def heads_sql(most: int) -> str:
    return f"coalesce(nullif(array_to_string(list_slice(heads, 1, {most}), ' | '), ''), 'None')"


@query("p25_source_analysis", f"SELECT page_id, {sections_sql(('MAIN TASK', chr(39) + 'Read page ' + chr(39) + ' || page_id'), ('SOURCE', SOURCE), ('HEADINGS', heads_sql(12)), ('PAGE TEXT', 'substr(body, 1, 7000)'), ('TABLES', TABLE_TEXT))} AS prompt FROM {PAGES}")
def source_analysis(spark, sf):
    return page_rows(spark, sf).select("page_id", R.source_prompt(page_context(), F.col("page_id") % 3, F.lit(3), F.col("host")).alias("prompt"))


GOAL = "CASE WHEN page_id % 2 = 0 THEN 'Read page ' || page_id ELSE 'Extract the most useful structured data from this page.' END"
SCRAPED = f"'Title: ' || title || {NL} || 'URL: ' || url || {NL} || 'Headings: ' || {heads_sql(15)}"


@query("p25_scrape_prompt", f"SELECT page_id, {sections_sql(('EXTRACTION GOAL', GOAL), ('PAGE', SCRAPED), ('PAGE TEXT', 'substr(body, 1, 9000)'), ('TABLES', TABLE_TEXT))} AS prompt FROM {PAGES}")
def scrape_prompt(spark, sf):
    own = page_context()
    return page_rows(spark, sf).select("page_id", R.scrape_prompt(R.replace(own, task=F.when(F.col("page_id") % 2 == 0, own.task))).alias("prompt"))


PERSON = "'  • Full name: ' || trim(title)"
PLAN = sections_sql(
    ("TASK", "'Read page ' || page_id"), ("CONTEXT", f"'URL: ' || url || {NL} || 'Title: ' || coalesce(nullif(title, ''), 'about:blank') || {NL} || 'Mode: ' || CASE page_id % 2 WHEN 0 THEN 'summarize' ELSE 'default' END"), ("READABLE TEXT", "substr(body, 1, 4000)"),
    ("OPEN TABS", objects_sql("[{'url': url, 'title': title}]", ("url", "title"), 1)), ("USER NOTES", lines_sql("heads")), ("USER PROFILE", f"CASE WHEN trim(title) <> '' THEN {PERSON} ELSE '  None' END"), ("ACTIVE SKILLS", "'  None'"), ("ATTACHMENTS", "'  None'"),
)
GROUND = sections_sql(("PAGE INSIGHTS", "'{\"links\":' || coalesce(len(links), 0) || '}'"), ("SCREENSHOT ANCHORS", "'[]'"), ("SELECTOR MAP", objects_sql("list_transform(coalesce(links, []), lambda v, i: {'uid': 'nx-' || i, 'selector': v['href']})", ("uid", "selector"), 10**6)))


def ground():
    size = F.when(F.size("links") > 0, F.size("links")).otherwise(0)
    selectors = F.transform("links", lambda v, i: F.struct(F.concat(F.lit("nx-"), (i + 1).cast("string")).alias("uid"), v["href"].alias("selector")))
    return R.grounding(F.to_json(F.struct(size.alias("links"))), None, selectors)


@query("p26_planner_request", f"SELECT page_id, {PLAN} || {NL} || {NL} || {GROUND} AS prompt, substr(title, 1, 4) AS screenshot, 1 AS n_images FROM {PAGES}")
def planner_request(spark, sf):
    own = page_context(mode=F.when(F.col("page_id") % 2 == 0, "summarize"), notes=F.col("headings"), tabs=F.array(F.struct("url", "title")), person=F.struct(F.col("title").alias("full_name")), person_fields=("full_name",))
    r = R.planner_request(own, ground(), F.substring("title", 1, 4), F.array(F.lit("one")))
    return page_rows(spark, sf).select("page_id", r.alias("r")).select("page_id", "r.prompt", "r.screenshot", F.size("r.images").alias("n_images"))


SKILLS_SQL = f"'  • Digest: Summarise what it says [allowed hosts: example.org, example.com | done when: done well; short]' || {NL} || '  • It''s found: Find it [preferred: a.org, b.org]'"


def own_skills(*which: int):
    def array(items):
        return F.array(*map(F.lit, items)).cast("array<string>")

    return F.array(*[F.struct(F.lit(s[0]).alias("id"), F.lit(s[1]).alias("name"), F.lit(s[2]).alias("prompt"), array(s[3]).alias("allowed_hosts"), array(s[4]).alias("preferred_sites"), array(s[5]).alias("checklist")) for s in (OWN[i] for i in which)])


#: The sections of a page's action prompt up to the links, and those from the hints on.
ACTION_PAGE = (
    ("CURRENT PAGE", f"'URL: ' || url || {NL} || 'Title: ' || coalesce(nullif(title, ''), 'unknown')"), ("PAGE TEXT", "substr(body, 1, 2500)"), ("READABLE TEXT", "''"), ("HEADINGS", texts_sql("heads", 20)),
    ("TABLES", texts_sql(f"[title || ' | ' || page_id || {NL} || 'links | ' || coalesce(len(links), 0), host]", 3)), ("OPEN TABS", "'[]'"), ("INTERACTIVE ELEMENTS", "'[]'"), ("VISIBLE LINKS", objects_sql("links", ("text", "href"), 20)),
)
SKILL_ACTION = sections_sql(
    ("TASK", f"'Iteration ' || page_id || {NL} || 'Summarise what it says' || {NL} || 'Mode: default'"), *ACTION_PAGE, ("RECENT ACTIONS", "'  None yet'"), ("LOOP HINTS", "'  None'"), ("USER NOTES", "'  None'"), ("USER PROFILE", "'  None'"),
    ("ACTIVE SKILLS", SKILLS_SQL.split(f" || {NL}")[0]), ("ATTACHMENTS", "'  None'"), ("PLAN", f"'[' || {NL} || '  \"Step 1: done well\",' || {NL} || '  \"Step 2: short\"' || {NL} || ']'"),
)


@query("p25_skill_action", f"SELECT page_id, {SKILL_ACTION} AS prompt FROM {PAGES}")
def skill_action(spark, sf):
    return page_rows(spark, sf).select("page_id", R.skill_action_prompt(own_skills(0)[0], page_context(iteration=F.col("page_id"))).alias("prompt"))


#: Events as steps: the kind of each, and a text; the last ten of the user up to each event go into its request.
KIND = "CASE event_type WHEN 'view' THEN 'thinking' WHEN 'click' THEN 'action' WHEN 'signup' THEN 'done' ELSE event_type END"
STEPS = f"(SELECT event_id, user_id, props, list({{'kind': {KIND}, 'text': props}}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS steps FROM events)"
ACTED = f"(SELECT *, list_filter(steps, lambda s: s['kind'] IN ('action', 'done', 'error', 'muted', 'stopped')) AS acted FROM {STEPS})"
NAVIGATED = sections_sql(
    ("TASK", f"'Iteration ' || event_id || {NL} || 'Go on' || {NL} || 'Mode: ' || CASE user_id % 5 WHEN 0 THEN 'summarize' ELSE 'default' END"), ("CURRENT PAGE", f"'URL: unknown' || {NL} || 'Title: unknown'"), ("PAGE TEXT", "''"), ("READABLE TEXT", "''"), ("HEADINGS", "'[]'"), ("TABLES", "'[]'"),
    ("OPEN TABS", "'[]'"), ("INTERACTIVE ELEMENTS", "'[]'"), ("VISIBLE LINKS", "'[]'"), ("RECENT ACTIONS", lines_sql("acted", "'[' || upper(x['kind']) || '] ' || x['text']", 8, True, "  ", "  None yet")), ("LOOP HINTS", lines_sql("[props]")), ("WORK SUMMARY", "'so far'", "event_id % 3 = 0"),
    ("USER NOTES", lines_sql("list_transform(range(1, (event_id % 8 + 1)::BIGINT), lambda i: 'note ' || i)", "x", 5, True)), ("USER PROFILE", "'  None'"), ("ACTIVE SKILLS", SKILLS_SQL), ("ATTACHMENTS", "'  None'"), ("PLAN", "'No plan provided'"),
)


@query("p26_navigator_request", f"SELECT event_id, {NAVIGATED} || {NL} || {NL} || 'ground' AS prompt, CASE WHEN user_id % 5 <> 0 AND event_id % 4 <> 0 THEN props END AS screenshot, CASE WHEN user_id % 5 <> 0 AND event_id % 4 <> 0 THEN 1 ELSE 0 END AS n_images FROM {ACTED}")
def navigator_request(spark, sf):
    i, events = F.col("event_id"), table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "thinking").when(F.col("event_type") == "click", "action").when(F.col("event_type") == "signup", "done").otherwise(F.col("event_type"))
    own = R.with_last_steps(events.withColumn("kind", kind), ["user_id"], ["ts", "event_id"], text="props")
    notes = F.when(i % 8 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (i % 8).cast("int"))), lambda k: F.concat(F.lit("note "), k.cast("string"))))
    context = R.Context(task=F.lit("Go on"), mode=F.when(F.col("user_id") % 5 == 0, "summarize"), steps=F.col("steps"), hints=F.array("props"), summary=F.when(i % 3 == 0, "so far"), notes=notes, skills=own_skills(0, 1), iteration=i)
    r = R.navigator_request(context, F.lit("ground"), F.col("props"), F.array("props"), F.when(i % 4 == 0, "minimal"))
    return own.select("event_id", r.alias("r")).select("event_id", "r.prompt", "r.screenshot", F.size("r.images").alias("n_images"))


@query("p25_synthesis_prompt", f"""SELECT task_id, {sections_sql(('RESEARCH QUESTION', chr(39) + 'Task ' + chr(39) + ' || task_id'), ('SUB-QUERIES', f"'1. first' || {NL} || '2. ' || task_id"), ('SOURCES', 'body'))} AS prompt FROM (SELECT task_id, string_agg('[' || rank || '] ' || coalesce(nullif(s.title, ''), s.url) || {NL} || 'URL: ' || s.url || {NL} || substr(b.body, 1, 1200), {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS body FROM ({DIVERSIFIED}) s JOIN (SELECT page_id, {BODY} AS body FROM pages) b ON s.pos = b.page_id GROUP BY task_id)""")
def synthesis(spark, sf):
    text = P.fields(table(spark, sf, "pages")).select(F.col("page_id").alias("pos"), "text")
    own = t02(spark, sf).join(text, "pos").groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", F.lit("").alias("summary"), F.lit("").alias("snippet"), "text"))).alias("sources"))
    task = F.col("task_id").cast("string")
    return own.select("task_id", R.synthesis_prompt(F.concat(F.lit("Task "), task), F.array(F.lit("first"), task), F.col("sources")).alias("prompt"))


@query("p25_decomposition", "SELECT conv_id, turn, '## RESEARCH QUESTION' || chr(10) || coalesce(text, '') AS prompt FROM conversations WHERE role = 'user'")
def decomposition(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", R.decomposition_prompt(F.col("text")).alias("prompt"))


HISTORY = f"(SELECT conv_id, arg_min(coalesce(text, ''), turn) AS task, CASE WHEN conv_id % 2 = 0 THEN arg_max(coalesce(text, ''), turn) ELSE '' END AS prior, string_agg(coalesce(role, '') || ': ' || substr(coalesce(text, ''), 1, 80), {NL} ORDER BY turn) AS steps FROM conversations GROUP BY conv_id)"


@query("p25_history_prompt", f"SELECT conv_id, {sections_sql(('TASK', 'task'), ('PRIOR SUMMARY', 'prior', "prior <> ''"), ('RECENT STEPS', 'steps'))} AS prompt FROM {HISTORY}")
def history(spark, sf):
    text = F.coalesce("text", F.lit(""))
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring(text, 1, 80))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by(text, "turn").alias("task"), F.max_by(text, "turn").alias("last"), F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    prior = F.when(F.col("conv_id") % 2 == 0, F.col("last")).otherwise("")
    return own.select("conv_id", R.history_prompt(F.col("task"), prior, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))


@query("p25_person_lines", f"SELECT c_custkey, coalesce(nullif(concat_ws({NL}, CASE WHEN trim(coalesce(c_name, '')) <> '' THEN '  • Full name: ' || trim(c_name) END, CASE WHEN c_custkey % 2 = 0 THEN '  • Phone: ' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN '  • Company: ' || trim(c_mktsegment) END), ''), '  None') AS lines FROM customer")
def person(spark, sf):
    k = F.col("c_custkey")
    own = F.struct(F.col("c_name").alias("full_name"), F.when(k % 2 == 0, k.cast("string")).otherwise("  ").alias("phone"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("company"))
    return table(spark, sf, "customer").select("c_custkey", R.person_lines(own, ("full_name", "phone", "company")).alias("lines"))


ATTACHED = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' END AS kind, CASE page_id % 5 WHEN 0 THEN NULL ELSE url END AS name, CASE page_id % 3 WHEN 0 THEN '' ELSE 'a/b' END AS mime, length(html)::BIGINT AS size, html, CASE page_id % 8 WHEN 1 THEN substr(html, 1, 20) ELSE '' END AS image FROM pages"


def attached(spark, sf):
    i = F.col("page_id")
    one = F.struct(
        F.concat(F.lit("p"), i.cast("string")).alias("id"), F.when(i % 4 == 0, "text").when(i % 4 == 1, "image").when(i % 4 == 2, "pdf").alias("kind"), F.when(i % 5 != 0, F.col("url")).alias("name"), F.when(i % 3 == 0, "").otherwise("a/b").alias("mime_type"),
        F.length("html").alias("size"), F.col("html").alias("text"), F.when(i % 2 == 0, F.length("html") > 1800).alias("truncated"), F.when(i % 8 == 1, F.substring("html", 1, 20)).alias("image"))
    return table(spark, sf, "pages").select("page_id", R.cloned_attachments(F.array(one)).alias("own"))


@query("p14_attachments", f"SELECT page_id, 'p' || page_id AS id, coalesce(kind, 'file') AS kind, coalesce(name, 'attachment') AS name, CASE mime WHEN '' THEN 'application/octet-stream' ELSE mime END AS mime_type, size, page_id % 2 = 0 AND size > 1800 AS truncated, CASE WHEN kind = 'image' AND image <> '' THEN 1 ELSE 0 END AS n_images FROM ({ATTACHED})")
def attachments(spark, sf):
    own = attached(spark, sf).withColumn("a", F.col("own")[0])
    return own.select("page_id", "a.id", "a.kind", "a.name", "a.mime_type", "a.size", "a.truncated", F.size(R.image_attachments(F.col("own"))).alias("n_images"))


@query("p25_attachment_lines", f"SELECT page_id, '  • ' || coalesce(name, 'attachment') || CASE kind WHEN 'text' THEN ' (' || m || '): ' || substr(html, 1, 1800) || CASE WHEN size > 1800 THEN ' …[truncated]' ELSE '' END WHEN 'image' THEN ' (image)' ELSE ' (' || m || ', ' || size || ' bytes)' END AS lines FROM (SELECT *, CASE mime WHEN '' THEN 'application/octet-stream' ELSE mime END AS m FROM ({ATTACHED}))")
def attachment_lines(spark, sf):
    return attached(spark, sf).select("page_id", R.attachment_lines(F.col("own")).alias("lines"))


MACRO = "regexp_matches(host, 'example[.](org|com)') OR (host <> '' AND (contains('example.org', host) OR contains('example.com', host)))"


@query("d07_skill_macros", f"SELECT page_id, CASE WHEN {MACRO} THEN {SKILLS_SQL.split(f' || {NL}')[0]} || {NL} || title END AS digest, '  • It''s found: Find it [preferred: a.org, b.org]' || {NL} || title AS found FROM {PAGES}")
def skill_macros(spark, sf):
    digest, found = R.register_skills(spark.createDataFrame(OWN, SKILL))
    return P.fields(table(spark, sf, "pages")).select("page_id", F.expr(f"{digest}(title, host)").alias("digest"), F.expr(f"{found}(title, host)").alias("found"))
