"""Plans, guards and context choices of an agent run, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import host_of
from .elements import ELEMENT_CAPS

# Ordered guards (kind, pattern on the action's joined, lower-cased fields); the first that matches counts.
GUARDS = (
    ("download", r"\b(download|save|export|install|csv|pdf)\b"), ("purchase", r"\b(buy|checkout|pay now|payment|place order|subscribe)\b"),
    ("account", r"\b(sign up|register|create account)\b"), ("auth", r"\b(sign in|log in|password|otp|2fa|mfa)\b"),
    ("permissions", r"\b(permission|allow notifications|camera|microphone|location)\b"), ("destructive", r"\b(delete|remove|erase|clear all|close account)\b"),
)
# Parts of error messages that tell their kind, host patterns of heavy pages, names of small local
# models, actions to verify, names of models that see, states of steps, limits, kinds of steps as they are shown.
FATAL = ("unauthorized", "401", "invalid api key", "insufficient_quota", "quota", "credit", "billing")
IMAGE_ERRORS = ("unable to download all specified images", "prompt contains", "context length", "image", "400")
COMPATIBILITY_ERRORS = ("response_format", "json_object", "image_url", "content", "vision", "multimodal", "unsupported", "invalid format", "400")
HEAVY_HOSTS = r"(youtube|amazon|flipkart|reddit|news|medium|linkedin|x\.com|twitter|google)"
SMALL_MODELS = ("llama3.2:1b", "llama3.2:3b", "phi3:mini", "phi3.5:mini", "phi4-mini", "gemma2:2b", "gemma3:1b", "gemma3:4b", "qwen2.5:0.5b", "qwen2.5:1.5b", "qwen2.5:3b", "smollm", "tinyllama", "moondream", "deepseek-r1:1.5b", "deepseek-r1:7b")
VERIFIED = ("navigate", "new_tab", "click", "search", "type", "fill", "submit")
MISTRAL_VISION = ("mistral-large", "mistral-medium", "mistral-small", "ministral", "pixtral", "vision")
LOCAL_VISION = ("llava", "bakllava", "vision", "qwen2.5vl", "qwen2-vl", "gemma3", "minicpm-v", "moondream")
MODEL_VISION = ("vision", "vl", "4o", "omni", "gemini", "pixtral", "llava", "qwen2.5vl", "qwen2-vl", "gemma3", "glm-4.5v", "glm-4.1v", "moonshot-v")
STATES = ("pending", "current", "done", "skipped")
#: Limits of a compacted page by mode: field, minimal, compact.
CAPS = {"text": (700, 1800), "readable_text": (2200, 5200), "headings": (8, 16), "tables": (1, 2), "links": (4, 10), "inputs": (6, 10), "clickables": (10, 18), "elements": (18, 32), "anchors": (10, 18), "selectors": (12, 20), "tabs": (4, 8), "element_text": (42, 80), "element_label": (48, 100), "stable_key": (80, 220)}
LISTS = ("headings", "tables", "links", "inputs", "clickables", "elements", "anchors", "selectors", "tabs")
#: Limits of the texts within a list's items by mode, minimal and compact (fixed values, too).
FIELD_CAPS = {"links": {"text": (60, 60), "href": (120, 120)}, "inputs": {"name": (42, 80)}, "clickables": ELEMENT_CAPS, "elements": ELEMENT_CAPS, "anchors": {"label": (48, 90)}, "selectors": {"text": (42, 80), "ax_name": (42, 80), "dom_path": (0, 120)}, "tabs": {"title": (44, 80), "url": (80, 160)}}
STEP_KINDS = {"thinking": "thinking", "screenshot": "screenshot", "api": "bullet", "action": "action", "plan_ready": "bullet", "executing": "spin", "done": "done", "error": "error", "stopped": "stopped", "checklist_update": "checklist"}


def says_any(c: Column, parts: tuple[str, ...]) -> Column:
    low, out = F.lower(T.or_empty(c)), F.lit(False)
    for p in parts:
        out |= F.contains(low, F.lit(p))
    return out


def guard(*fields: Column) -> Column:
    """The kind of the first guard that an action's fields set off; null if none does."""
    said = F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
    out = None
    for kind, pattern in GUARDS:
        out = F.when(said.rlike(pattern), kind) if out is None else out.when(said.rlike(pattern), kind)
    return out


def small_model(name: Column) -> Column:
    low = F.lower(T.or_empty(name))
    size = F.regexp_extract(low, r":(\d+(\.\d+)?)b", 1)
    return says_any(name, SMALL_MODELS) | F.coalesce(F.nullif(size, F.lit("")).cast("double") <= 4, F.lit(False))


def context_mode(provider: Column, role: Column, host: Column, text_length: Column, elements: Column, tabs: Column, profile: Column, force_minimal: Column, model: Column) -> Column:
    """``normal``, ``compact`` or ``minimal``: how much of a page a prompt carries."""
    p, heavy = F.lower(T.or_empty(provider)), host.rlike(HEAVY_HOSTS)
    return (
        F.when(force_minimal, "minimal")
        .when((p == "ollama") & small_model(model), "minimal")
        .when((p == "mistral") & (heavy | (text_length > 4000) | (elements > 30)), "minimal")
        .when(p == "mistral", "compact")
        .when(role.isin("synthesizer", "extractor"), F.when((text_length > 7000) | heavy, "compact").otherwise("normal"))
        .when(heavy | (elements > 45) | (text_length > 8000) | (tabs > 8) | (profile == "deep_research"), "compact")
        .otherwise("normal")
    )


def capped(value: Column, field: str, mode: Column) -> Column:
    """A text or array cut to the field's limit in the mode; ``normal`` leaves it whole."""
    least, more = CAPS[field]

    def cut(n: int) -> Column:
        return F.slice(value, 1, n) if field in LISTS else F.substring(value, 1, n)

    return F.when(mode == "minimal", cut(least)).when(mode == "compact", cut(more)).otherwise(value)


def compacted_page(pages: DataFrame, mode: str = "mode") -> DataFrame:
    """Pages as a prompt carries them in their ``mode``: every part of ``CAPS`` that is a column is cut, with what lies in it.

    ``headings`` are texts, ``tables`` arrays of rows; ``links``, ``inputs``,
    ``clickables``, ``elements``, ``anchors``, ``selectors`` and ``tabs`` arrays of
    structs, of which the fields in ``FIELD_CAPS`` are cut where they exist. The
    readable text falls back on the text, an element's label and name on each
    other and its text. Minimal anchors lose their ``center``. Nulls become empty
    texts and lists; a page in ``normal`` mode, or a null one, stays as it is.
    """
    m = F.col(mode)
    small = m.isin("minimal", "compact")

    def cut_item(part: str, x: Column, fields: list[str]) -> Column:
        own = {c: T.or_empty(x[c]) for c in FIELD_CAPS[part] if c in fields}
        if part in ("clickables", "elements"):
            given = {c: x[c] if c in fields else F.lit("") for c in ("label", "ax_name", "aria_label", "text")}
            fallback = {"label": T.first_of(given["label"], given["ax_name"], given["text"]), "ax_name": T.first_of(given["ax_name"], given["aria_label"], given["text"])}
            own |= {c: f for c, f in fallback.items() if c in fields}
        out = x
        for c, value in own.items():
            least, more = FIELD_CAPS[part][c]
            out = out.withField(c, F.when(m == "minimal", F.substring(value, 1, least)).otherwise(F.substring(value, 1, more)))
        return out.withField("center", F.when(m != "minimal", x["center"])) if "center" in fields else out

    def cutter(part: str, fields: list[str]):
        return lambda x: cut_item(part, x, fields)

    parts = {}
    for name in [c for c in ("text", "readable_text") if c in pages.columns]:
        whole = T.first_of(F.col(name), F.col("text")) if "text" in pages.columns else T.or_empty(F.col(name))
        parts[name] = F.when(small, capped(whole, name, m)).otherwise(F.col(name))
    for name in [c for c in LISTS if c in pages.columns]:
        kind = pages.schema[name].dataType
        kept = capped(F.coalesce(F.col(name), F.array().cast(kind)), name, m)
        if name in FIELD_CAPS:
            fields = kind.elementType.names
            kept = F.transform(kept, cutter(name, fields))
        parts[name] = F.when(small, kept).otherwise(F.col(name))
    return pages.withColumns(parts)


def plan_states(raw: Column) -> Column:
    """The states of a new plan's steps, given as an array: odd ones are pending, the first one current; one is current if any is pending."""
    valid = F.transform(raw, lambda s, i: F.when(s.isin(*STATES), s).when(i == 0, "current").otherwise("pending"))
    first = F.array_position(valid, "pending")
    return F.when(F.array_contains(valid, "current") | (first == 0), valid).otherwise(F.transform(valid, lambda s, i: F.when(i + 1 == first, "current").otherwise(s)))


def normalized_plan(steps: DataFrame, plan: str = "plan_id", pos: str = "pos") -> DataFrame:
    """Plan steps with valid states: the first is current by default, and the first pending one if none is current."""
    first = F.col(pos) == 0
    state = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(F.when(first, "current").otherwise("pending"))
    own = steps.withColumn("status", state).withColumn("text", F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("Step "), (F.col(pos) + 1).cast("string"))))
    w = Window.partitionBy(plan)
    own = own.withColumn("__any", F.max(F.col("status") == "current").over(w)).withColumn("__next", F.min(F.when(F.col("status") == "pending", F.col(pos))).over(w))
    return own.withColumn("status", F.when(~F.col("__any") & (F.col(pos) == F.col("__next")), "current").otherwise(F.col("status"))).drop("__any", "__next")


def advanced(status: Column, pos: Column, size: Column, wanted: Column) -> Column:
    """A step's state after progress to step ``wanted``, which is clamped to the plan; a null leaves states alone."""
    at = F.greatest(F.lit(0), F.least(wanted, size - 1))
    return (
        F.when(wanted.isNull(), status)
        .when((pos < at) & status.isin("pending", "current"), "done")
        .when(pos == at, "current")
        .when((pos > at) & (status == "current"), "pending")
        .otherwise(status)
    )


def task_profile(explicit: Column, skill_ids: Column) -> Column:
    ids = F.transform(skill_ids, lambda x: F.lower(x))
    own = F.nullif(F.nullif(explicit, F.lit("")), F.lit("default"))
    deep = F.array_contains(ids, "builtin_research_deep") | F.array_contains(ids, "builtin_multi_source")
    return F.when(own.isNotNull(), own).when(F.array_contains(ids, "builtin_summarise"), "summarize").when(deep, "deep_research").otherwise("default")


def checkpoint(kind: Column) -> Column:
    return F.when(kind.isin("navigate", "new_tab"), "before_navigate").when(kind == "click", "before_click")


def description(kind: Column, selector: Column, text: Column, url: Column, query: Column) -> Column:
    """One line about an action."""
    what = T.first_of(selector, text)
    return (
        F.when(kind == "navigate", F.concat(F.lit("Navigate → "), T.or_empty(url)))
        .when(kind == "click", F.concat(F.lit('Click "'), what, F.lit('"')))
        .when(kind == "type", F.concat(F.lit('Type "'), F.substring(T.or_empty(text), 1, 40), F.lit('" into '), T.or_empty(selector)))
        .when(kind == "fill", F.concat(F.lit('Fill "'), T.or_empty(selector), F.lit('" ← "'), F.substring(T.or_empty(text), 1, 30), F.lit('"')))
        .when(kind == "search", F.concat(F.lit('Search "'), T.or_empty(query), F.lit('"')))
        .when(kind == "new_tab", F.concat(F.lit("New tab → "), T.or_empty(url)))
        .when(kind == "submit", "Submit form")
        .when(kind == "done", "Done")
        .otherwise(kind)
    )


def display_kind(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in STEP_KINDS.items() for x in kv])
    return F.coalesce(names[kind], F.lit("bullet"))


def provider_vision(provider: Column, model: Column, text_model: Column, vision_model: Column, custom: Column) -> Column:
    """Whether the configured model of a provider takes images."""
    p = F.lower(T.first_of(provider, F.lit("openai")))
    own = F.trim(T.or_empty(model))
    return (
        F.when(p.isin("openai", "anthropic", "gemini"), True)
        .when(p == "mistral", says_any(T.first_of(own, F.lit("mistral-small-2506")), MISTRAL_VISION))
        .when(p == "ollama", says_any(T.first_of(F.trim(T.first_of(vision_model, model)), F.lit("llava:7b")), LOCAL_VISION))
        .when(p == "kimi", says_any(T.first_of(own, F.lit("kimi-k2.5")), MODEL_VISION))
        .when(p == "glm", says_any(T.first_of(own, F.lit("glm-4.7")), MODEL_VISION))
        .when(p == "custom", F.coalesce(custom, F.lit(False)) | says_any(own, MODEL_VISION))
        .otherwise(False)
    )


def unapproved_hosts(actions: DataFrame, approved: DataFrame) -> DataFrame:
    """Navigations to hosts that are neither approved nor planned (``host`` of ``approved``)."""
    own = actions.withColumn("host", host_of(F.col("url"))).where(F.col("type").isin("navigate", "new_tab") & (F.col("host") != ""))
    return own.join(approved.select("host").distinct(), "host", "left_anti")
