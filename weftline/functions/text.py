"""Text functions over columns. Lengths and places count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (the Unicode space separators, line ends and the byte-order mark).
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Words that carry no meaning when a task is matched.
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "have", "has", "its", "into", "but", "not", "can", "you", "all",
    "use", "get", "any", "how", "what", "when", "where", "who", "will", "our", "my", "your", "their", "them", "then", "than", "also",
    "about", "want", "need", "make", "just", "like", "some", "more", "does", "did",
)
# Patterns of contact data and domains in running text.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"\+?\d[\d\s()-]{7,}\d"
DOMAIN = r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def normalize(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(or_empty(c), f"{SPACE}+", " "))


def for_matching(c: Column, drop_prefix: bool = False) -> Column:
    """Lower case, letters and digits only, single blanks. ``drop_prefix`` also drops a leading ``text:``."""
    low = F.lower(or_empty(c))
    low = F.regexp_replace(low, "^text:", "") if drop_prefix else low
    return normalize(F.regexp_replace(low, rf"[^\p{{L}}\p{{N}}\s]", " "))


def words(c: Column) -> Column:
    """The distinct words of an already normalised text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def key_words(c: Column) -> Column:
    """The distinct words of more than two letters that are no stop words."""
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_of_larger(a: Column, b: Column) -> Column:
    """Shared members over the size of the larger set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.greatest(F.size(a), F.size(b)))


def overlap_of_first(a: Column, b: Column) -> Column:
    """Shared members over the size of the first set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.size(a))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter length over longer length; 0 if either text is empty."""
    x, y = F.length(or_empty(a)), F.length(or_empty(b))
    return F.when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def found(c: Column, pattern: str, most: int | None = None) -> Column:
    """The distinct matches of a pattern, normalised, in order of first occurrence."""
    hits = F.array_distinct(F.transform(F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(0)), normalize))
    return F.slice(hits, 1, most) if most else hits


def emails(c: Column) -> Column:
    return found(c, EMAIL, 30)


def phones(c: Column) -> Column:
    return found(c, PHONE, 30)


def domains(c: Column) -> Column:
    return found(F.lower(or_empty(c)), DOMAIN)


def escape_attribute(c: Column) -> Column:
    return F.replace(F.replace(or_empty(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_html(c: Column, quote: bool = False) -> Column:
    """Markup characters as entities; ``quote`` includes the apostrophe."""
    c = or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")) + ((("'", "&#39;"),) if quote else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_first_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(or_empty(c), rf"^[^\s]+\s*", ""))


def without_leading_symbol(c: Column) -> Column:
    """Without one leading pictograph, its variation selector and the blanks after it."""
    return F.trim(F.regexp_replace(or_empty(c), r"^[\x{1F300}-\x{1FFFF}\x{2600}-\x{27FF}]\x{FE0F}?\s*", ""))


def json_text(c: Column) -> Column:
    """The JSON object in a model's reply: fences dropped, else the part from the first to the last brace; null if neither parses."""
    clean = F.trim(F.regexp_replace(or_empty(c), "```json\\n?|```\\n?", ""))
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)

    def good(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)

    return F.coalesce(good(clean), good(inner))


def block_text(c: Column) -> Column:
    """What stands between the first pair of ``<blocks>`` tags; the text itself if there is none."""
    inner = F.regexp_extract(or_empty(c), r"(?is)<blocks>(.*?)</blocks>", 1)
    return F.when(inner != "", inner).otherwise(or_empty(c))


def done_items(c: Column) -> Column:
    """The trimmed, non-empty items of all ``[DONE: item]`` marks."""
    items = F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"(?i)\[DONE:\s*([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def clamp_int(c: Column, least: int, most: int, fallback: int) -> Column:
    """The integer that a text begins with, within bounds; ``fallback``, unclamped, if there is none."""
    n = F.regexp_extract(or_empty(c), r"^\s*([+-]?\d+)", 1)
    return F.when(n == "", F.lit(fallback)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), n.cast("bigint")))).cast("bigint")


def token_count_label(n: Column) -> Column:
    """1.23M, 4.5k or the number itself; halves round up."""
    m, k = F.floor((n + 5000) / 10000), F.floor((n + 50) / 100)
    millions = F.concat(F.floor(m / 100).cast("string"), F.lit("."), F.lpad((m % 100).cast("string"), 2, "0"), F.lit("M"))
    thousands = F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("k"))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, thousands).otherwise(n.cast("string"))


def elapsed_label(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


# Labels of a session's states.
STATUS_LABELS = {
    "idle": "Idle", "done": "Completed", "error": "Error", "stopped": "Stopped by user", "incomplete": "Incomplete (max steps)",
    "running": "Running…", "planning": "Planning…", "paused": "Waiting for approval",
}


def status_label(c: Column) -> Column:
    out = None
    for k, v in STATUS_LABELS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(c)


# The rewriting steps from Markdown to HTML, in their order.
MARKDOWN_STEPS = (
    ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
    (r"(?m)^#{4,6}\s+(.+)$", "<h4>$1</h4>"), (r"(?m)^###\s+(.+)$", "<h3>$1</h3>"), (r"(?m)^##\s+(.+)$", "<h2>$1</h2>"), (r"(?m)^#\s+(.+)$", "<h2>$1</h2>"),
    (r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>"),
    (r"`([^`]+)`", "<code>$1</code>"), (r"(?m)^[-*+]\s+(.+)$", "<li>$1</li>"), (r"(?m)^\d+\.\s+(.+)$", "<li>$1</li>"),
    (r"(?s)((?:<li>.*?</li>\n?)+)", "<ul>$1</ul>"), (r"\n{2,}", "</p><p>"), (r"\A", "<p>"), (r"\z", "</p>"), (r"\[(\d+)\]", '<sup class="cite">[$1]</sup>'),
)


def markdown_to_html(c: Column) -> Column:
    c = or_empty(c)
    for pattern, by in MARKDOWN_STEPS:
        c = F.regexp_replace(c, pattern, by)
    return c


def result_to_html(c: Column) -> Column:
    """The lighter form for result cards: escapes, bold, bullets and line breaks."""
    c = escape_html(c, quote=True)
    c = F.regexp_replace(c, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"(?m)^(\s*)[-*]\s+(.*)$", "$1• $2")
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def mime_type(c: Column) -> Column:
    low = F.lower(or_empty(c))
    return F.when(F.contains(low, F.lit("png")), "image/png").when(F.contains(low, F.lit("webp")), "image/webp").when(F.contains(low, F.lit("gif")), "image/gif").otherwise("image/jpeg")


def base64_text(c: Column) -> Column:
    """Without white space and without a data-URL prefix."""
    s = F.regexp_replace(or_empty(c), r"\s+", "")
    return F.when(F.startswith(s, F.lit("data:image")) & F.contains(s, F.lit(",")), F.regexp_replace(s, "^[^,]*,", "")).otherwise(s)
