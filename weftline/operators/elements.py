"""Interactive elements: labels, keys, differences between snapshots and matching of action targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of

FIELDS = ("label", "ax_name", "aria_label", "text", "placeholder", "title_attr", "name", "id", "role", "tag", "type", "href", "dom_path")


def complete(df: DataFrame) -> DataFrame:
    """``df`` with an empty text for each element field that it lacks."""
    return df.withColumns({c: F.lit("") for c in FIELDS if c not in df.columns})


def role_of(role: Column, tag: Column, kind: Column) -> Column:
    """The role named, else by tag; other fields are search boxes or text boxes."""
    by_tag = F.when(tag == "a", "link").when(tag == "button", "button").when(tag == "select", "select").when(F.lower(kind) == "search", "searchbox").otherwise("textbox")
    return F.when(T.or_empty(role) != "", role).otherwise(by_tag)


def label() -> Column:
    return F.substring(T.normalize(T.first_of(*[F.col(c) for c in ("label", "ax_name", "aria_label", "text", "placeholder", "title_attr", "name", "id")])), 1, 160)


def ax_name(own_label: Column) -> Column:
    return F.substring(T.normalize(T.first_of(F.col("ax_name"), F.col("aria_label"), F.col("title_attr"), own_label)), 1, 160)


def stable_key() -> Column:
    """A key that survives re-rendering: the element's non-empty fields, lower-cased."""
    raw = [F.lower(T.or_empty(F.col(c))) for c in ("role", "tag", "type")]
    texts = [F.lower(T.normalize(F.col(c))) for c in ("text", "placeholder", "aria_label", "name")]
    href = F.substring(F.lower(F.trim(T.or_empty(F.col("href")))), 1, 180)
    parts = [*raw, *texts, href, F.lower(T.normalize(F.col("dom_path")))]
    return F.substring(F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts]), 1, 420)


def match_text() -> Column:
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("text", "ax_name", "aria_label", "placeholder", "title_attr", "name", "id", "href")]
    return F.substring(T.normalize(F.concat_ws(" ", *parts)), 1, 220)


def enrich(elements: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Elements of snapshots (``page_id``, ``url``, ``pos``, fields) with label, keys, host and ``is_new``.

    An element is new if the previous snapshot of the page has the same URL but
    no element with its key. Without a previous snapshot nothing is new.
    """
    own = complete(elements)
    own = own.withColumn("uid", F.regexp_replace(F.coalesce(F.nullif(F.col("uid"), F.lit("")), F.concat(F.lit("nx-"), F.col("pos").cast("string"))), "^uid:", "")) if "uid" in own.columns else own.withColumn("uid", F.concat(F.lit("nx-"), F.col("pos").cast("string")))
    named = label()
    own = own.withColumns({"own_label": named, "stable_key": stable_key(), "match_text": match_text(), "link_host": host_of(F.col("href"))})
    own = own.withColumn("own_ax_name", ax_name(F.col("own_label")))
    if previous is None:
        return own.withColumn("is_new", F.lit(False))
    before = complete(previous).withColumn("stable_key", stable_key())
    pages = before.select("page_id", F.col("url").alias("__url")).distinct()
    keys = before.select("page_id", "stable_key", F.lit(True).alias("__seen")).distinct()
    out = own.join(pages, "page_id", "left").join(keys, ["page_id", "stable_key"], "left")
    new = F.coalesce((F.col("__url") == F.col("url")) & (F.col("stable_key") != "") & F.col("__seen").isNull(), F.lit(False))
    return out.withColumn("is_new", new).drop("__url", "__seen")


def boosted(score: Column, w: Column, h: Column) -> Column:
    """A little more for elements of a clickable size."""
    area = F.coalesce(w, F.lit(0)) * F.coalesce(h, F.lit(0))
    return F.when((area > 1000) & (area < 200_000), score + 0.03).otherwise(score)


def target_score(target: Column, item: dict[str, Column]) -> Column:
    """How well an element (columns by field name) fits a normalised target text, before the size boost.

    Containment in text, label, accessible name or placeholder decides, in that
    order; else the best weighted word overlap, with small terms for the role
    and state.
    """
    f = {c: T.for_matching(item.get(c, F.lit("")), True) for c in ("text", "label", "ax_name", "placeholder", "href", "dom_path")}

    def within(a: Column) -> Column:
        return (a != "") & (F.contains(a, target) | F.contains(target, a))

    words = T.words(target)
    weights = (("text", 1.0), ("label", 0.92), ("ax_name", 0.86), ("href", 0.75), ("dom_path", 0.45))
    best = F.greatest(*[T.overlap_of_first(words, T.words(f[c])) * w for c, w in weights])
    role, tag = F.lower(T.or_empty(item.get("role", F.lit("")))), F.lower(T.or_empty(item.get("tag", F.lit(""))))
    best = best + F.when((role == "link") | (tag == "a"), 0.08).otherwise(0.0) + F.when((role == "button") | (tag == "button"), 0.03).otherwise(0.0)
    best = best + F.when(item.get("is_new", F.lit(False)), 0.02).otherwise(0.0) - F.when(item.get("disabled", F.lit(False)), 0.2).otherwise(0.0)
    return (
        F.when(target == "", 0.0)
        .when(within(f["text"]), T.length_ratio(target, f["text"]) + 0.32)
        .when(within(f["label"]), T.length_ratio(target, f["label"]) + 0.28)
        .when(within(f["ax_name"]), T.length_ratio(target, f["ax_name"]) + 0.24)
        .when((f["placeholder"] != "") & F.contains(f["placeholder"], target), T.length_ratio(target, f["placeholder"]) + 0.18)
        .otherwise(best)
    )


def match_targets(actions: DataFrame, elements: DataFrame, least: float = 0.34) -> DataFrame:
    """The element that each action (``action_id``, ``page_id``, ``uid``, ``selector``, ``wanted``) means on its page.

    Tiers in order: uid, selector, same text, same label, placeholder that
    contains the text, best score of at least ``least``; within a tier the first
    element, for scores the best, then the first. Actions without a match get no row.
    """
    own = complete(elements).drop("label").withColumnRenamed("own_label", "label") if "own_label" in elements.columns else complete(elements)
    a = actions.select("action_id", "page_id", F.regexp_replace(T.first_of(F.col("uid"), F.col("selector")), "^uid:", "").alias("a_uid"), T.or_empty(F.col("selector")).alias("a_selector"), F.lower(F.trim(T.first_of(F.col("wanted"), F.regexp_replace(T.or_empty(F.col("selector")), "^text:", "")))).alias("a_text"))
    e = own.select("page_id", "pos", F.col("uid").alias("e_uid"), F.concat(F.lit("uid:"), F.col("uid")).alias("e_selector"), "text", "label", "ax_name", "placeholder", "href", "dom_path", "role", "tag")
    both = a.join(e, "page_id")
    said = F.col("a_text")
    score = target_score(T.for_matching(said, True), {c: F.col(c) for c in ("text", "label", "ax_name", "placeholder", "href", "dom_path", "role", "tag")})
    tier = (
        F.when((F.col("a_uid") != "") & (F.col("a_uid") == F.col("e_uid")), 1)
        .when((F.col("a_selector") != "") & (F.col("a_selector") == F.col("e_selector")), 2)
        .when((said != "") & (F.lower(F.trim(T.or_empty(F.col("text")))) == said), 3)
        .when((said != "") & (F.lower(F.trim(T.first_of(F.col("label"), F.col("ax_name")))) == said), 4)
        .when((said != "") & F.contains(F.lower(F.trim(T.or_empty(F.col("placeholder")))), said), 5)
        .when((said != "") & (F.col("score") >= least), 6)
    )
    both = both.withColumn("score", score).withColumn("tier", tier).where("tier is not null")
    w = Window.partitionBy("action_id").orderBy("tier", F.when(F.col("tier") == 6, -F.col("score")).otherwise(0.0), "pos")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("action_id", "page_id", "pos", "tier", F.col("e_selector").alias("selector"))


#: Fixed values. Limits of an element in a compacted page: field, minimal, compact (0: left empty).
ELEMENT_CAPS = {"text": (42, 80), "label": (48, 100), "ax_name": (48, 100), "placeholder": (42, 80), "href": (0, 120), "dom_path": (0, 160), "stable_key": (80, 220)}
#: Elements of a compacted page: minimal, compact.
ELEMENTS_KEPT = (18, 32)


def compacted(elements: DataFrame, by: str = "page_id", pos: str = "pos") -> DataFrame:
    """Elements as a prompt carries them in their page's ``mode``: the first ones, fields cut; ``normal`` leaves all as they are.

    Label and name fall back on each other and on the text before they are cut.
    """
    own = complete(elements)
    mode = F.col("mode")
    raw = {c: T.or_empty(F.col(c)) for c in ELEMENT_CAPS if c != "stable_key"} | {"stable_key": T.or_empty(F.col("stable_key")) if "stable_key" in own.columns else stable_key()}
    raw |= {"label": T.first_of(F.col("label"), F.col("ax_name"), F.col("text")), "ax_name": T.first_of(F.col("ax_name"), F.col("aria_label"), F.col("text"))}
    cut = {c: F.when(mode == "minimal", F.substring(raw[c], 1, a)).when(mode == "compact", F.substring(raw[c], 1, b)).otherwise(raw[c] if c == "stable_key" else F.col(c)) for c, (a, b) in ELEMENT_CAPS.items()}
    place = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    most = F.when(mode == "minimal", ELEMENTS_KEPT[0]).when(mode == "compact", ELEMENTS_KEPT[1])
    return own.withColumn("__place", place).where(most.isNull() | (F.col("__place") <= most)).drop("__place").withColumns(cut)


def search_input_score(hints: Column, kind: Column, top: Column, width: Column, window_height: Column) -> Column:
    """How much a field looks like the page's search box, from its type, the words in its attributes and its place."""
    low = F.lower(T.or_empty(hints))

    def points(test: Column, n: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    return (
        points(F.lower(T.or_empty(kind)) == "search", 6) + points(F.contains(low, F.lit("search")), 5) + points(F.contains(low, F.lit("find")), 4) + points(F.contains(low, F.lit("query")), 3)
        + points(low.rlike(r"\bqs?\b"), 3) + points(top < window_height * 0.45, 2) + points(width > 120, 1)
    )


def best_search_input(inputs: DataFrame, by: str = "page_id", pos: str = "pos") -> DataFrame:
    """The field of each page with the highest ``score``, the first of equal ones."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), pos)
    return inputs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
