"""Scans of pages, candidate ranking and page-level derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of
from ..operators import pages as P
from ..sources import html as H
from . import duck as D
from .registry import derived, query, table

PREFERRED = ["m.ththth.example.net", "ththre.example.com", "blog.thth.example.com"]
PREFERRED_SQL = ", ".join(D.lit(h) for h in PREFERRED)


def plain_sql(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {D.lit(a)}, {D.lit(b)})"
    return D.normalize(c)


TITLE = plain_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")
HEADS = f"list_filter(list_transform(regexp_extract_all(html, {D.lit(P.HEADING)}, 1), lambda h: {plain_sql('h')}), lambda h: h <> '')[1:20]"
BODY = f"substr({plain_sql('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g'), '(?is)<head\\b.*?</head>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')''')}, 1, 18000)"
PAGE, ROOT = f"regexp_extract(url, {D.lit(P.FOLDER)}, 1)", f"regexp_extract(url, {D.lit(P.ROOT)}, 1)"
ABSOLUTE = f"""CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || h WHEN starts_with(h, '/') THEN {ROOT} || h
WHEN starts_with(h, '#') THEN regexp_replace(url, '#.*$', '') || h WHEN starts_with(h, '?') THEN {PAGE} || h ELSE CASE WHEN {PAGE} = {ROOT} THEN {PAGE} || '/' ELSE regexp_replace({PAGE}, '/[^/]*$', '/') END || h END"""


def links_sql(pages: str) -> str:
    found = ", ".join(f"regexp_extract_all(html, {D.lit(P.LINK)}, {i}) AS x{i}" for i in (1, 2, 3, 4))
    return f"""(SELECT page_id, url, pos, {ABSOLUTE} AS href, {plain_sql('t')} AS text
FROM (SELECT page_id, url, pos, replace(trim(concat(a, b, c)), '&amp;', '&') AS h, coalesce(t, '') AS t FROM (SELECT page_id, url, unnest(range(1, len(x1) + 1)) AS pos, unnest(x1) AS a, unnest(x2) AS b, unnest(x3) AS c, unnest(x4) AS t FROM (SELECT page_id, url, {found} FROM {pages}))))"""


LINKS = links_sql("pages")
#: Pages with links as they are written by hand: quotes, attributes, tags inside, relative addresses.
WRITTEN = """SELECT page_id, CASE page_id % 2 WHEN 0 THEN url ELSE url || '/x/y.html?q=1#z' END AS url, CASE page_id % 4 WHEN 0 THEN '<a class="k" href="/p">One</a><A HREF=''b.html'' id=q>Two <b>bold</b></A><a href=c target=_blank>Three</a><a name="no">anchor</a><a data-href="d" href="//e.org/f">Four</a>'
WHEN 1 THEN '<a href="g?x=1&amp;y=2">Five</a><a href="#top">Six</a><a href="?s=1">Seven</a><a href="mailto:h@i.org">Eight</a><a
href = "/j">Nine <!-- c --> more</a><abbr href="n">no</abbr>'
WHEN 2 THEN '<a href="e">open <a href="f">Ten</a><p>no link</p>' || html ELSE NULL END AS html FROM pages"""
H1 = plain_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")
CANDIDATES = f"(SELECT page_id % 50 AS task_id, page_id % 4 AS query_idx, page_id AS pos, url, {D.host_of('url')} AS host, {H1} AS title FROM pages)"


@query("s01_page_fields", f"SELECT page_id, {TITLE} AS title, array_to_string({HEADS}, '|') AS headings, {BODY} AS text FROM pages")
def s01(spark, sf):
    return P.fields(table(spark, sf, "pages")).select("page_id", "title", F.array_join("headings", "|").alias("headings"), "text")


@query("s01_readable_page")
def s01_readable(spark, sf):
    return H.readable_pages(table(spark, sf, "pages"))


@query("s02_page_elements")
def s02(spark, sf):
    return H.page_elements(table(spark, sf, "pages"))


SERP = f"""WITH c AS (SELECT *, {D.host_of('href')} AS host, text AS title FROM {LINKS} WHERE length(text) >= 8),
d AS (SELECT * FROM c WHERE regexp_matches(href, '(?i)^https?:') AND host <> '' AND NOT (contains(host, 'google.com') OR contains(host, 'bing.com') OR contains(host, 'duckduckgo.com')) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT page_id, pos::BIGINT AS pos, href, host, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (host IN ({PREFERRED_SQL})) DESC, length(title) DESC, pos) AS rank FROM d) WHERE rank <= 8"""


@query("s03_search_results", SERP)
def s03(spark, sf):
    own = P.links(table(spark, sf, "pages")).where(F.length("text") >= 8).withColumn("title", F.col("text"))
    return P.ranked_results(own, ["page_id"], PREFERRED).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "host", "title", F.col("rank").cast("bigint").alias("rank"))


@query("f02_web_urls", f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https?:') AND {D.host_of('url')} <> ''")
def f02(spark, sf):
    return table(spark, sf, "pages").where(P.is_web_url(F.col("url"))).select("page_id", "url")


SEARCHED = D.rows("host", "('google.com')", "('news.google.com')", "('notbing.com')", "('example.org')", "('duckduckgo.com.evil.net')", "('')", "(NULL)")


@query("f03_no_search_hosts", f"SELECT host FROM ({SEARCHED} UNION ALL SELECT {D.host_of('url')} FROM pages) WHERE NOT (contains(coalesce(host, ''), 'google.com') OR contains(coalesce(host, ''), 'bing.com') OR contains(coalesce(host, ''), 'duckduckgo.com'))")
def f03(spark, sf):
    return spark.sql(SEARCHED).union(table(spark, sf, "pages").select(host_of(F.col("url")))).where(~P.is_search_host(F.col("host")))


@query("s01_written_links", f"SELECT page_id, pos::BIGINT AS pos, href, text FROM {links_sql(f'({WRITTEN})')}")
def s01_written(spark, sf):
    return P.links(derived(spark, sf, WRITTEN)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "text")


#: No page has a card with a link, so each list item with a longer link is a result, whose text is its snippet, too.
@query("s03_result_cards", f"SELECT page_id, rank, href, host, title, substr(title, 1, 300) AS snippet FROM ({SERP})")
def s03_cards(spark, sf):
    return H.search_cards(table(spark, sf, "pages"), PREFERRED).withColumn("rank", F.col("rank").cast("bigint"))


#: Each page with written cards before its own text: preferred and search hosts, no title, a repeated and a hidden card, a nested one.
CARDED = """SELECT page_id, url, '<body><div class=g><a href="https://b.example.org/' || page_id || '">Link</a><h3>A longer title of ' || page_id || '</h3><p>Snip <b>one</b></p></div><div class="result x"><a href="https://www.c.example.org/"></a><span class=snippet>' || repeat('ab ', 150) || '</span></div>
<div class=g style="Display: none"><a href="https://hidden.example.org">Hidden title</a></div><article><a href="https://www.google.com/x">Search again</a><h2>Search</h2><article hidden><p>no</p></article></article><article><a href="https://ththre.example.com/p">Own</a><article><h2>Inner title</h2><a href="https://b.example.org/' || page_id || '">Repeated</a></article></article></body>' || html AS html FROM pages"""


@query("s03_written_cards", """SELECT page_id, unnest([1, 2, 3]) AS rank, unnest(['https://ththre.example.com/p', 'https://b.example.org/' || page_id, 'https://www.c.example.org/']) AS href, unnest(['ththre.example.com', 'b.example.org', 'c.example.org']) AS host,
unnest(['Inner title', 'A longer title of ' || page_id, 'c.example.org']) AS title, unnest(['', 'Snip one', substr(repeat('ab ', 150), 1, 300)]) AS snippet FROM pages""")
def s03_written(spark, sf):
    return H.search_cards(derived(spark, sf, CARDED), PREFERRED)


#: Each page's address and size in elements of which some lie in hidden ones.
HIDING = """SELECT page_id, '<body><nav style="visibility:hidden"><ul><li><a href="/no">no</a></ul></nav><div hidden><form><input name=q><button>go</button></form></div><input type=hidden name=t value=1><a href="' || url || '">Page ' || page_id || '</a><p style="display : block">x <button disabled>' || length(html) || '</button></p><div style="color:red; display:none"><select></select></div><input type=search placeholder="Find ' || page_id || '"></body>' AS html FROM pages"""


@query("f01_shown_elements", "SELECT page_id, unnest([1, 2, 3]) AS pos, unnest(['link', 'button', 'searchbox']) AS role, unnest(['Page ' || page_id, length(html)::VARCHAR, '']) AS text, unnest([url, '', '']) AS href, unnest(['', '', 'Find ' || page_id]) AS placeholder, unnest([false, true, false]) AS disabled FROM pages")
def f01(spark, sf):
    return H.page_elements(derived(spark, sf, HIDING)).select("page_id", "pos", "role", "text", "href", "placeholder", "disabled")


@query("f04_fallback_links", f"SELECT page_id, count(*) FILTER (length(text) >= 8) AS usable, count(*) AS n FROM {LINKS} GROUP BY page_id")
def f04(spark, sf):
    return P.links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count_if(F.length("text") >= 8).alias("usable"), F.count("*").alias("n"))


@query("f04_usable_links", f"SELECT page_id, pos::BIGINT AS pos, href, text FROM {LINKS} WHERE length(text) >= 8")
def f04_usable(spark, sf):
    return P.links(table(spark, sf, "pages")).where(F.length("text") >= 8).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "text")


@query("t08_first_links", f"SELECT page_id, pos::BIGINT AS pos, href FROM {LINKS} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3")
def t08_first(spark, sf):
    return P.links(table(spark, sf, "pages")).where("pos <= 3").select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


#: A task's queries, of which each finds the pages of its number and, before them, the links they hold.
FOUND = f"(SELECT page_id % 10 AS task_id, page_id % 4 AS query_idx, page_id * 1000 + pos AS place, href AS url FROM {LINKS} UNION ALL SELECT page_id % 10, page_id % 4, page_id * 1000, url FROM pages)"


@query("g07_first_by_url", f"SELECT task_id, query_idx, place, url FROM {FOUND} WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY task_id, url ORDER BY query_idx, place) = 1")
def g07_by_url(spark, sf):
    own = table(spark, sf, "pages")
    i = F.col("page_id")
    links = P.links(own).select((i % 10).alias("task_id"), (i % 4).alias("query_idx"), (i * 1000 + F.col("pos")).alias("place"), F.col("href").alias("url"))
    found = links.union(own.select(i % 10, i % 4, i * 1000, "url")).where(F.coalesce("url", F.lit("")) != "")
    return P.first_per_key(found, ["task_id", "url"], ["query_idx", "place"])


@query("g07_first_by_host", f"SELECT host, query_idx, pos, url FROM {CANDIDATES} QUALIFY row_number() OVER (PARTITION BY host ORDER BY query_idx, pos) = 1")
def g07(spark, sf):
    return P.first_per_key(P.candidates_of(table(spark, sf, "pages")), ["host"], ["query_idx", "pos"]).select("host", "query_idx", "pos", "url")


@query("g08_distinct_elements", f"""SELECT page_id, pos::BIGINT AS pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS idx, key FROM (SELECT page_id, pos, lower('link|' || text || '|||' || href || '|') AS key FROM {LINKS})
QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY pos) = 1""".replace("row_number() OVER (PARTITION BY page_id ORDER BY pos) AS idx, ", ""))
def g08(spark, sf):
    key = F.lower(F.concat(F.lit("link|"), F.col("text"), F.lit("|||"), F.col("href"), F.lit("|")))
    return P.first_per_key(P.links(table(spark, sf, "pages")).withColumn("key", key), ["page_id", "key"], ["pos"]).select("page_id", F.col("pos").cast("bigint").alias("pos"), "key")


@query("g09_longest_container", f"""SELECT page_id, CASE WHEN a >= b THEN 'article' ELSE 'body' END AS container, greatest(a, b)::BIGINT AS size FROM
(SELECT page_id, length({plain_sql("regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)")}) AS a, length({plain_sql("regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1)")}) AS b FROM pages)""")
def g09(spark, sf):
    h = F.col("html")
    boxes = F.array(*[F.struct(F.length(P.plain(F.regexp_extract(h, rf"(?s)<{tag}[^>]*>(.*)</{tag}>", 1))).alias("size"), F.lit(-i).alias("order"), F.lit(tag).alias("tag")) for i, tag in enumerate(("article", "body"))])
    return table(spark, sf, "pages").select("page_id", F.array_max(boxes).alias("b")).select("page_id", F.col("b.tag").alias("container"), F.col("b.size").cast("bigint").alias("size"))


DIVERSIFIED = f"""WITH o AS (SELECT *, host IN ({PREFERRED_SQL}) AS pref FROM {CANDIDATES} WHERE coalesce(url, '') <> ''),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY task_id, coalesce(nullif(host, ''), 'url ' || url) ORDER BY pref DESC, host, length(title), pos) = 1)
SELECT task_id, rank, pos, url, host, title FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pref DESC, host, length(title), pos) AS rank FROM k) WHERE rank <= 6"""


@query("t02_diversified_sources", DIVERSIFIED)
def t02(spark, sf):
    return P.diversified(P.candidates_of(table(spark, sf, "pages")), ["task_id"], PREFERRED).select("task_id", F.col("rank").cast("bigint").alias("rank"), "pos", "url", "host", "title")


@query("t03_preferred_sources", f"SELECT task_id, rank, url FROM (SELECT task_id, url, row_number() OVER (PARTITION BY task_id ORDER BY (host IN ({PREFERRED_SQL})) DESC, pos) AS rank FROM {CANDIDATES} QUALIFY row_number() OVER (PARTITION BY task_id, url ORDER BY pos) = 1) WHERE rank <= 6")
def t03(spark, sf):
    from pyspark.sql import Window

    own = P.first_per_key(P.candidates_of(table(spark, sf, "pages")), ["task_id", "url"], ["pos"])
    w = Window.partitionBy("task_id").orderBy(F.col("host").isin(*PREFERRED).desc(), "pos")
    return own.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("task_id", F.col("rank").cast("bigint").alias("rank"), "url")


@query("j04_preferred_flag", f"SELECT page_id, {D.host_of('url')} IN ({PREFERRED_SQL}) AS preferred FROM pages")
def j04(spark, sf):
    return table(spark, sf, "pages").select("page_id", host_of(F.col("url")).isin(*PREFERRED).alias("preferred"))


@query("g10_source_list", f"""WITH s AS ({DIVERSIFIED}) SELECT task_id, string_agg('[' || rank || '] ' || coalesce(nullif(title, ''), nullif(url, ''), 'Untitled') || chr(10) || 'URL: ' || url, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS sources FROM s GROUP BY task_id""")
def g10(spark, sf):
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.nullif("url", F.lit("")), F.lit("Untitled")), F.lit("\nURL: "), F.col("url"))
    own = t02(spark, sf).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return own.select("task_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n---\n\n").alias("sources"))


@query("p15_page_summary", f"SELECT page_id, substr({D.normalize(f'{BODY}')}, 1, 700) AS summary FROM pages")
def p15(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.substring(T.normalize(P.body_text(F.col("html"))), 1, 700).alias("summary"))


@query("x27_roles", f"SELECT page_id, pos::BIGINT AS pos, CASE pos % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'select' WHEN 3 THEN 'searchbox' ELSE 'textbox' END AS role FROM {LINKS}")
def x27(spark, sf):
    from ..operators.elements import role_of

    i = F.col("pos") % 5
    tag = F.when(i == 0, "button").when(i == 1, "a").when(i == 2, "select").otherwise("input")
    return P.links(table(spark, sf, "pages")).select("page_id", F.col("pos").cast("bigint").alias("pos"), role_of(F.lit(""), tag, F.when(i == 3, "Search").otherwise("text")).alias("role"))


@query("x16_cleaned_html")
def x16(spark, sf):
    return H.readable_pages(table(spark, sf, "pages")).select("page_id", "cleaned_html")


@query("x26_dom_paths")
def x26(spark, sf):
    return H.page_elements(table(spark, sf, "pages")).select("page_id", "pos", "dom_path")
