"""Fields, links and candidate sources of captured pages, by pattern on the raw HTML.

Built-in functions only, so that scans stay in generated code; ``sources.html``
has the full parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, or_empty
from ..functions.urls import host_of

#: A link: its address in double, single or no quotes, and what it holds, tags included.
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
#: The root and the folder of an address.
ROOT = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"
FOLDER = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(?:/[^?#]*)?)"
HEADING = r"(?s)<h[123][^>]*>(.*?)</h[123]>"
# Hosts that are search engines themselves (tested as parts of the host, so look-alikes are excluded as well).
SEARCH_HOSTS = ("google.com", "bing.com", "duckduckgo.com")


def plain(html: Column) -> Column:
    """Markup as text: tags dropped, common entities resolved, white space collapsed."""
    c = F.regexp_replace(or_empty(html), "<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return normalize(c)


def title(html: Column) -> Column:
    return plain(F.regexp_extract(or_empty(html), r"(?s)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, most: int = 20) -> Column:
    hits = F.transform(F.regexp_extract_all(or_empty(html), F.lit(HEADING), F.lit(1)), plain)
    return F.slice(F.filter(hits, lambda h: h != ""), 1, most)


def body_text(html: Column, most: int = 18_000) -> Column:
    """The text of the page's body without scripts, styles and comments."""
    inner = F.regexp_replace(or_empty(html), r"(?is)<(script|style|noscript|head)\b.*?</\1>|<!--.*?-->", " ")
    return F.substring(plain(inner), 1, most)


def fields(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``title``, ``headings`` and ``text`` of each page."""
    h = F.col("html")
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), title(h).alias("title"), headings(h).alias("headings"), body_text(h).alias("text"))


def links(pages: DataFrame) -> DataFrame:
    """A row for each link: ``page_id``, ``url``, ``pos`` (from 1), ``href`` made absolute, ``text``."""
    h = or_empty(F.col("html"))
    found = [F.regexp_extract_all(h, F.lit(LINK), F.lit(i)) for i in (1, 2, 3, 4)]
    pairs = F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(found, "abct", strict=True)]), lambda x: F.struct(F.concat(x["a"], x["b"], x["c"]).alias("href"), x["t"].alias("text")))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("i", "l"))
    return rows.select("page_id", "url", (F.col("i") + 1).alias("pos"), absolute(F.col("url"), F.replace(F.trim("l.href"), F.lit("&amp;"), F.lit("&"))).alias("href"), plain(F.col("l.text")).alias("text"))


def absolute(url: Column, href: Column) -> Column:
    """``href`` as it stands on the page ``url``; steps such as ``..`` are kept."""
    page = F.regexp_extract(url, FOLDER, 1)
    folder = F.when(page == F.regexp_extract(url, ROOT, 1), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, "/[^/]*$", "/"))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(F.regexp_extract(url, ROOT, 1), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(url, "#.*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )


def is_web_url(url: Column) -> Column:
    return or_empty(url).rlike("(?i)^https?:") & (host_of(url) != "")


def is_search_host(host: Column) -> Column:
    out = F.lit(False)
    for h in SEARCH_HOSTS:
        out |= F.contains(or_empty(host), F.lit(h))
    return out


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Not ``dropDuplicates``, which keeps any row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked_results(candidates: DataFrame, by: list[str], preferred: list[str], most: int = 8) -> DataFrame:
    """Search results of each ``by`` group: preferred hosts first, then longer titles, then ``pos``; ``rank`` from 1."""
    own = candidates.where(is_web_url(F.col("href")) & ~is_search_host(host_of(F.col("href"))))
    own = first_per_key(own, [*by, "href"], ["pos"]).withColumn("host", host_of(F.col("href")))
    w = Window.partitionBy(*by).orderBy(F.col("host").isin(*preferred).desc(), F.length("title").desc(), "pos")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def diversified(candidates: DataFrame, by: list[str], preferred: list[str], most: int = 6) -> DataFrame:
    """Sources of each ``by`` group, one a host: preferred hosts, then host, shorter title and ``pos``; ``rank`` from 1.

    Rows with an empty host stand for themselves, one a URL; rows without a URL are left out.
    """
    own = candidates.where(or_empty(F.col("url")) != "")
    first = F.col("host").isin(*preferred).desc()
    order = [first, F.col("host"), F.length(or_empty(F.col("title"))), F.col("pos")]
    key = F.coalesce(F.nullif(F.col("host"), F.lit("")), F.concat(F.lit("url "), F.col("url")))
    one = own.withColumn("__n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).where("__n = 1").drop("__n")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def candidates_of(pages: DataFrame, tasks: int = 50) -> DataFrame:
    """Pages as candidate sources: ``task_id``, ``query_idx``, ``pos``, ``url``, ``host``, ``title``."""
    h1 = plain(F.regexp_extract(or_empty(F.col("html")), r"(?s)<h1[^>]*>(.*?)</h1>", 1))
    return pages.select((F.col("page_id") % tasks).alias("task_id"), (F.col("page_id") % 4).alias("query_idx"), F.col("page_id").alias("pos"), "url", host_of(F.col("url")).alias("host"), h1.alias("title"))
