"""URL and host functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_empty

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host without ``www.``; empty if the text is no URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(or_empty(url)), AUTHORITY, 1)), "^www[.]", "")


def normalize_host(value: Column) -> Column:
    """The host of a URL or of a bare host with or without path."""
    raw = F.trim(or_empty(value))
    whole = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = host_of(whole)
    plain = F.regexp_replace(F.regexp_replace(raw, "(?i)^https?://", ""), "(?i)^www[.]", "")
    return F.when(raw == "", "").when(host != "", host).otherwise(F.lower(F.trim(F.split(plain, "/")[0])))


def url_component(c: Column) -> Column:
    """Percent-encoding of a URL component: blanks as %20, and ! ' ( ) * ~ left alone."""
    out = F.url_encode(or_empty(c))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def search_url(engine: Column, query: Column) -> Column:
    q = url_component(F.trim(or_empty(query)))
    name = F.lower(or_empty(engine))
    return (
        F.when(name == "duckduckgo", F.concat(F.lit("https://duckduckgo.com/?q="), q, F.lit("&ia=web")))
        .when(name == "bing", F.concat(F.lit("https://www.bing.com/search?q="), q))
        .otherwise(F.concat(F.lit("https://www.google.com/search?q="), q))
    )


def site_hints(value: Column, on_space: bool = False) -> Column:
    """The distinct hosts named in a text, separated by commas or line ends (``on_space``: or blanks, repeats kept)."""
    hosts = F.filter(F.transform(F.split(or_empty(value), r"[\n,\s]+" if on_space else r"[\n,]"), normalize_host), lambda h: h != "")
    return hosts if on_space else F.array_distinct(hosts)


# Words in a task that name a site.
SITE_WORDS = (
    ("amazon", "amazon.in"), ("flipkart", "flipkart.com"), ("github", "github.com"), ("linkedin", "linkedin.com"), ("youtube", "youtube.com"),
    ("wikipedia", "wikipedia.org"), ("imdb", "imdb.com"), ("stackoverflow", "stackoverflow.com"), ("medium", "medium.com"), ("news", "news.google.com"),
)
# Base addresses of hosted compatible services.
SERVICE_URLS = {"deepseek": "https://api.deepseek.com/v1", "kimi": "https://api.moonshot.ai/v1", "glm": "https://open.bigmodel.cn/api/paas/v4"}


def service_base_url(provider: Column, custom: Column) -> Column:
    """A compatible service's base address: a custom one without endpoint and with a version, else the provider's own."""
    own = F.regexp_replace(F.regexp_replace(F.trim(or_empty(custom)), "/+$", ""), "/+(chat/)?completions$", "")
    low = F.lower(own)
    versioned = F.endswith(low, F.lit("/v1")) | F.endswith(low, F.lit("/v4")) | F.contains(low, F.lit("/api/"))
    default = F.lit("")
    for name, url in SERVICE_URLS.items():
        default = F.when(F.lower(or_empty(provider)) == name, url).otherwise(default)
    return F.when(own == "", default).when(versioned, own).otherwise(F.concat(own, F.lit("/v1")))


def local_base_url(value: Column, default: str = "http://127.0.0.1:11434") -> Column:
    return F.regexp_replace(F.trim(F.when(or_empty(value) == "", default).otherwise(value)), "/+$", "")
