"""Skill catalogue, scoring of skills for tasks, and checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of

# The built-in skills (id, name, description, category, allowed hosts, checklist) and their key words.
BUILT_IN = (
    ("builtin_summarise", "Summarise Page", "Extract and summarise the key points of the current page.", "Research", [], ["Page content has been summarised", "Key points are listed", "Summary is under 300 words"]),
    ("builtin_price_check", "Price Comparison", "Find and compare the price of the searched product across top shopping sites.", "Shopping", ["amazon.in", "amazon.com", "flipkart.com"], ["Prices found on at least 2 sites", "Ratings extracted where available", "Best deal identified"]),
    ("builtin_extract_emails", "Extract Emails & Contacts", "Scrape all email addresses and contact details from the current page.", "Data Extraction", [], ["Page fully scrolled", "All emails extracted", "All phone numbers extracted", "Results structured by type"]),
    ("builtin_research_deep", "Multi-Source Research", "Research a topic across 3+ independent sources and compare findings.", "Research", [], ["At least 3 independent sources visited", "Key claims noted per source", "Synthesis written with citations", "Conflicting information flagged"]),
    ("builtin_fill_form", "Smart Form Filler", "Detect and fill all visible form fields using user-provided information.", "Form Filling", [], ["All visible form fields identified", "Fields filled with appropriate data", "Form not submitted unless explicitly requested"]),
)
KEY_WORDS = {
    "builtin_summarise": ["summarize", "summarise", "tldr", "summary", "overview", "brief", "explain"],
    "builtin_price_check": ["price", "cost", "buy", "cheap", "compare", "shopping", "deal", "discount", "amazon", "flipkart"],
    "builtin_extract_emails": ["email", "contact", "phone", "address", "reach out", "mail"],
    "builtin_research_deep": ["research", "find", "analyze", "investigate", "report", "deep dive", "compare", "versus", "vs"],
    "builtin_fill_form": ["fill", "form", "apply", "register", "signup", "sign up", "submit"],
}
CATEGORIES = ("Research", "Shopping", "Social", "Productivity", "Data Extraction", "Form Filling", "Custom")
SCHEMA = "id string, name string, description string, category string, allowed_hosts array<string>, checklist array<string>, built_in boolean, pos int"
LEAST_SCORE, MOST_SKILLS = 0.38, 2


def catalogue(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """The built-in skills, then the user's; ``pos`` keeps the order, ids may repeat."""
    base = spark.createDataFrame([(*s, True, i) for i, s in enumerate(BUILT_IN)], SCHEMA)
    if own is None:
        return base
    return base.unionByName(own.withColumn("pos", F.col("pos") + len(BUILT_IN)).select(base.columns))


def cleaned(skills: DataFrame) -> DataFrame:
    """Trimmed and bounded fields, a known category, lower-cased hosts, no empty entries."""

    def kept(c: str, low: bool = False) -> Column:
        items = F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) if low else F.trim(x))
        return F.filter(items, lambda x: x != "")

    return skills.withColumns({"name": F.substring(F.trim(T.or_empty(F.col("name"))), 1, 80), "description": F.substring(F.trim(T.or_empty(F.col("description"))), 1, 300), "category": F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("Custom"), "allowed_hosts": kept("allowed_hosts", True), "checklist": kept("checklist")})


def host_allowed(host: Column, allowed: Column) -> Column:
    """Whether a host and one of the allowed hosts contain one another."""
    return (host != "") & F.exists(allowed, lambda h: F.contains(host, F.lower(F.trim(h))) | F.contains(F.lower(F.trim(h)), host))


def scored(tasks: DataFrame, skills: DataFrame) -> DataFrame:
    """Every task (``task_id``, ``task``, ``page_url``) with every skill and its ``score``.

    The catalogue is a small dimension: it is broadcast only while it has at
    most 10,000 rows, else the pairs are made by a plain join.
    """
    words = F.create_map(*[x for k, v in KEY_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    side = skills.withColumns({"hits": F.coalesce(words[F.col("id")], F.array().cast("array<string>")), "skill_words": T.key_words(T.for_matching(F.concat_ws(" ", T.or_empty(F.col("name")), T.or_empty(F.col("description")))))})
    side = F.broadcast(side) if len(side.select("id").take(10_001)) <= 10_000 else side
    t = tasks.withColumns({"task_norm": T.for_matching(F.col("task")), "host": host_of(F.col("page_url"))}).withColumn("task_words", T.key_words(F.col("task_norm")))
    both = t.crossJoin(side)
    k = F.size(F.filter("hits", lambda w: F.contains(F.col("task_norm"), w)))
    score = F.when(host_allowed(F.col("host"), F.col("allowed_hosts")), 0.55).otherwise(0.0) + F.least(F.lit(0.45), k * 0.14) + T.overlap_of_larger(F.col("task_words"), F.col("skill_words")) * 0.30
    vague = ~F.col("built_in") & (F.size("allowed_hosts") == 0) & (F.size("hits") == 0)
    return both.withColumn("score", F.least(F.lit(1.0), score - F.when(vague, 0.10).otherwise(0.0)))


def chosen(tasks: DataFrame, skills: DataFrame, active: list[str] | None = None) -> DataFrame:
    """The best two skills of each task that reach the threshold and aren't active already; ``rank`` from 1."""
    own = scored(tasks, skills.where(~F.col("id").isin(*active)) if active else skills)
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "pos")
    return own.where(F.col("score") >= LEAST_SCORE).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST_SKILLS)


def checklist_marks(replies: DataFrame, skills: DataFrame) -> DataFrame:
    """Checklist items that replies (``session``, ``pos``, ``text``) mark as done, once a session, at the first mark.

    A mark counts if a checklist item contains its first 20 characters, in any case.
    """
    marks = replies.select("session", "pos", F.posexplode(T.done_items(F.col("text"))).alias("i", "item"))
    known = skills.select(F.explode("checklist").alias("known")).distinct()
    hit = marks.join(known, F.contains(F.lower("known"), F.substring(F.lower("item"), 1, 20)), "left_semi")
    w = Window.partitionBy("session", "item").orderBy("pos", "i")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("session", "pos", "item")
