"""Prompts and requests as text columns: sections with caps, conditions and lists.

Only what depends on data is here; fixed instructions are the caller's and may be
put around it. A builder takes a :class:`Context`, whose fields are columns that
may all be missing or null; a missing part is said to be none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Limits of the prompts' parts, in characters (TEXT) or entries (MOST).
TEXT = {"plan": 4000, "action": 2500, "readable": 5000, "source": 7000, "scrape": 9000, "body": 1200, "attachment": 1800, "skill": 700}
MOST = {"headings": 20, "tables": 3, "links": 20, "notes": 5, "actions": 8, "steps": 10, "attachments": 6, "skills": 6, "sources": 20, "source headings": 12, "source tables": 2, "source rows": 5, "scrape headings": 15, "scrape tables": 3, "scrape rows": 8}
#: Kinds of steps that count as actions, and the labels of a person's data in their order.
ACTIONS = ("action", "done", "error", "muted", "stopped")
PERSON = {"full_name": "Full name", "email": "Email", "phone": "Phone", "address": "Address", "company": "Company", "website": "Website", "notes": "Notes"}
NONE = "  None"


@dataclass(frozen=True)
class Context:
    """What a prompt is made of; every field is a column.

    ``tables``: arrays of rows of cells; ``links``, ``tabs``, ``elements``: arrays of
    structs; ``skills``: structs of id, name, prompt, allowed_hosts,
    preferred_sites, checklist; ``attachments``: structs of kind, name, mime_type,
    size, text, truncated; ``steps``: structs of kind and text, oldest first;
    ``person``: a struct with fields of ``PERSON``.
    """

    task: Column | None = None
    url: Column | None = None
    title: Column | None = None
    text: Column | None = None
    readable: Column | None = None
    headings: Column | None = None
    tables: Column | None = None
    links: Column | None = None
    tabs: Column | None = None
    elements: Column | None = None
    mode: Column | None = None
    notes: Column | None = None
    skills: Column | None = None
    attachments: Column | None = None
    person: Column | None = None
    person_fields: tuple[str, ...] = tuple(PERSON)
    steps: Column | None = None
    hints: Column | None = None
    summary: Column | None = None
    plan: Column | None = None
    iteration: Column | None = None


@dataclass(frozen=True)
class Section:
    """A titled part of a prompt, left out where ``when`` isn't true."""

    title: str
    body: Column
    when: Column | None = field(default=None)


def rendered(*sections: Section) -> Column:
    """The sections as one text, a blank line between them."""
    parts = [F.concat(F.lit(f"## {s.title}\n"), T.or_empty(s.body)) for s in sections]
    return F.concat_ws("\n\n", *[p if s.when is None else F.when(s.when, p) for p, s in zip(parts, sections, strict=True)])


def listed(items: Column | None, each: Callable[[Column], Column] = T.or_empty, most: int | None = None, last: bool = False, lead: str = "  • ", empty: str = NONE) -> Column:
    """A line for each item, the first ``most`` or the last ones; ``empty`` where there is none."""
    if items is None:
        return F.lit(empty)
    start = F.greatest(F.size(items) - most + 1, F.lit(1)) if last and most else F.lit(1)
    own = items if most is None else F.slice(items, start, most)
    return F.when(F.size(items) > 0, F.array_join(F.transform(own, lambda x: F.concat(F.lit(lead), each(x))), "\n")).otherwise(empty)


def quoted(c: Column) -> Column:
    """A text as JSON."""
    inner = F.to_json(F.array(T.or_empty(c)))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def json_texts(items: Column | None, most: int | None = None) -> Column:
    """Texts as an indented JSON array."""
    if items is None:
        return F.lit("[]")
    own = items if most is None else F.slice(items, 1, most)
    return F.when(F.size(items) > 0, F.concat(F.lit("[\n  "), F.array_join(F.transform(own, quoted), ",\n  "), F.lit("\n]"))).otherwise("[]")


def json_objects(items: Column | None, keys: tuple[str, ...], most: int | None = None) -> Column:
    """Structs as an indented JSON array of objects with the given keys, all of them texts."""
    if items is None:
        return F.lit("[]")

    def one(x: Column) -> Column:
        return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'    "{k}": '), quoted(x[k].cast("string"))) for k in keys]), F.lit("\n  }"))

    own = items if most is None else F.slice(items, 1, most)
    return F.when(F.size(items) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(own, one), ",\n"), F.lit("\n]"))).otherwise("[]")


def table_texts(tables: Column | None, most: int, rows: int) -> Column:
    """The first rows of the first tables, cells divided by bars."""
    if tables is None:
        return F.lit("None")

    def one(t: Column, i: Column) -> Column:
        return F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), F.array_join(F.transform(F.slice(t, 1, rows), lambda r: F.array_join(r, " | ")), "\n"))

    return F.when(F.size(tables) > 0, F.array_join(F.transform(F.slice(tables, 1, most), one), "\n\n")).otherwise("None")


def _cut(c: Column | None, n: int) -> Column:
    return F.lit("") if c is None else F.substring(T.or_empty(c), 1, n)


def _or(c: Column | None, default: str) -> Column:
    return F.lit(default) if c is None else T.first_of(c, F.lit(default))


def attachment_lines(items: Column | None) -> Column:
    """A line for each of the first attachments: the text of texts, kind and size of others."""

    def one(a: Column) -> Column:
        text = F.concat(T.or_empty(a["name"]), F.lit(" ("), T.first_of(a["mime_type"], F.lit("text")), F.lit("): "), _cut(a["text"], TEXT["attachment"]), F.when(a["truncated"], " …[truncated]").otherwise(""))
        image = F.concat(T.or_empty(a["name"]), F.lit(" (image)"))
        other = F.concat(T.or_empty(a["name"]), F.lit(" ("), T.first_of(a["mime_type"], F.lit("file")), F.lit(", "), F.coalesce(a["size"], F.lit(0)).cast("string"), F.lit(" bytes)"))
        return F.when(a["kind"] == "text", text).when(a["kind"] == "image", image).otherwise(other)

    return listed(items, one, MOST["attachments"])


def skill_lines(items: Column | None) -> Column:
    """A line for each of the first skills: name, prompt and what bounds it."""

    def one(s: Column) -> Column:
        def part(name: str, c: Column, sep: str) -> Column:
            return F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, sep)))

        extras = F.concat_ws(" | ", part("allowed hosts", s["allowed_hosts"], ", "), part("preferred", s["preferred_sites"], ", "), part("done when", s["checklist"], "; "))
        return F.concat(T.or_empty(s["name"]), F.lit(": "), _cut(s["prompt"], TEXT["skill"]), F.when(extras != "", F.concat(F.lit(" ["), extras, F.lit("]"))).otherwise(""))

    return listed(items, one, MOST["skills"])


def person_lines(person: Column | None, names: tuple[str, ...] = tuple(PERSON)) -> Column:
    """A line for each field of a person's data that isn't blank."""
    if person is None:
        return F.lit(NONE)
    lines = F.concat_ws("\n", *[F.when(F.trim(T.or_empty(person[k])) != "", F.concat(F.lit(f"  • {label}: "), F.trim(person[k]))) for k, label in PERSON.items() if k in names])
    return F.when(lines != "", lines).otherwise(NONE)


def action_lines(steps: Column | None) -> Column:
    """The last actions among the steps, oldest first."""
    if steps is None:
        return F.lit("  None yet")
    own = F.filter(steps, lambda s: s["kind"].isin(*ACTIONS))
    return listed(own, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("] "), T.or_empty(s["text"])), MOST["actions"], last=True, lead="  ", empty="  None yet")


def _page(c: Context, unknown: str) -> Column:
    return F.concat(F.lit("URL: "), _or(c.url, unknown), F.lit("\nTitle: "), _or(c.title, unknown))


def plan_prompt(c: Context) -> Column:
    """What a plan is made from: the task, the page, notes, person, skills and attachments."""
    readable = _cut(c.text if c.readable is None else c.readable if c.text is None else T.first_of(c.readable, c.text), TEXT["plan"])
    return rendered(
        Section("TASK", _or(c.task, "")), Section("CONTEXT", F.concat(_page(c, "about:blank"), F.lit("\nMode: "), _or(c.mode, "default"))), Section("READABLE TEXT", readable),
        Section("OPEN TABS", json_objects(c.tabs, ("url", "title"))), Section("USER NOTES", listed(c.notes)), Section("USER PROFILE", person_lines(c.person, c.person_fields)),
        Section("ACTIVE SKILLS", skill_lines(c.skills)), Section("ATTACHMENTS", attachment_lines(c.attachments)),
    )


def action_prompt(c: Context) -> Column:
    """What the next action is chosen from: the page in full, recent actions, hints, and the plan for reference."""
    tables = json_texts(F.transform(c.tables, lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), "\n")) if c.tables is not None else None, MOST["tables"])
    summary = c.summary if c.summary is not None else F.lit("")
    return rendered(
        Section("TASK", F.concat(F.lit("Iteration "), F.coalesce(c.iteration.cast("string"), F.lit("0")) if c.iteration is not None else F.lit("0"), F.lit("\n"), _or(c.task, ""), F.lit("\nMode: "), _or(c.mode, "default"))),
        Section("CURRENT PAGE", _page(c, "unknown")), Section("PAGE TEXT", _cut(c.text, TEXT["action"])), Section("READABLE TEXT", _cut(c.readable, TEXT["readable"])),
        Section("HEADINGS", json_texts(c.headings, MOST["headings"])), Section("TABLES", tables), Section("OPEN TABS", json_objects(c.tabs, ("url", "title"))),
        Section("INTERACTIVE ELEMENTS", json_objects(c.elements, ("uid", "role", "text"))), Section("VISIBLE LINKS", json_objects(c.links, ("text", "href"), MOST["links"])),
        Section("RECENT ACTIONS", action_lines(c.steps)), Section("LOOP HINTS", listed(c.hints)), Section("WORK SUMMARY", summary, T.or_empty(summary) != ""),
        Section("USER NOTES", listed(c.notes, most=MOST["notes"], last=True)), Section("USER PROFILE", person_lines(c.person, c.person_fields)), Section("ACTIVE SKILLS", skill_lines(c.skills)),
        Section("ATTACHMENTS", attachment_lines(c.attachments)), Section("PLAN", json_texts(c.plan) if c.plan is not None else F.lit("No plan provided")),
    )


def skill_action_prompt(skill: Column, c: Context) -> Column:
    """The action prompt of a single skill: its prompt is the task, its checklist the plan."""
    steps = F.transform(skill["checklist"], lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x))
    return action_prompt(replace(c, task=skill["prompt"], plan=steps, skills=F.array(skill), notes=None, attachments=None, person=None, summary=None, hints=None, mode=None))


def grounding(insights: Column, anchors: Column | None, selectors: Column | None) -> Column:
    """What ties a screenshot's numbers to elements: insights as JSON, anchors, and uid to selector."""
    return rendered(Section("PAGE INSIGHTS", insights), Section("SCREENSHOT ANCHORS", json_objects(anchors, ("uid", "label"))), Section("SELECTOR MAP", json_objects(selectors, ("uid", "selector"))))


def decomposition_prompt(task: Column) -> Column:
    return rendered(Section("RESEARCH QUESTION", task))


def synthesis_prompt(task: Column, queries: Column | None, sources: Column) -> Column:
    """The question, the queries asked, and the first sources (structs of title, url, summary, snippet, text), numbered."""
    numbered = F.transform(F.slice(sources, 1, MOST["sources"]), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), T.first_of(s["title"], s["url"], F.lit("Untitled")), F.lit("\nURL: "), T.or_empty(s["url"]), F.lit("\n"), _cut(T.first_of(s["summary"], s["snippet"], s["text"]), TEXT["body"])))
    asked = F.lit("1. Original query")
    if queries is not None:
        asked = F.when(F.size(queries) > 0, F.array_join(F.transform(queries, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")).otherwise(asked)
    return rendered(Section("RESEARCH QUESTION", task), Section("SUB-QUERIES", asked), Section("SOURCES", F.when(F.size(sources) > 0, F.array_join(numbered, "\n\n---\n\n")).otherwise("No sources provided.")))


def _headings(c: Context, most: int) -> Column:
    return F.lit("None") if c.headings is None else T.first_of(F.array_join(F.slice(c.headings, 1, most), " | "), F.lit("None"))


def source_prompt(c: Context, index: Column, total: Column, host: Column) -> Column:
    """One source of several (``index`` from 0) with its page's headings, text and tables."""
    text = _cut(c.text if c.readable is None else T.first_of(c.readable, _or(c.text, "")), TEXT["source"])
    own = F.concat(F.lit("Source "), (index + 1).cast("string"), F.lit(" of "), total.cast("string"), F.lit("\nTitle: "), _or(c.title, "Untitled"), F.lit("\nURL: "), _or(c.url, ""), F.lit("\nHost: "), T.or_empty(host))
    return rendered(Section("MAIN TASK", _or(c.task, "")), Section("SOURCE", own), Section("HEADINGS", _headings(c, MOST["source headings"])), Section("PAGE TEXT", text), Section("TABLES", table_texts(c.tables, MOST["source tables"], MOST["source rows"])))


def scrape_prompt(c: Context) -> Column:
    """A page from which rows are to be taken for the task, or whatever is most useful if there is none."""
    text = _cut(c.text if c.readable is None else T.first_of(c.readable, _or(c.text, "")), TEXT["scrape"])
    return rendered(
        Section("EXTRACTION GOAL", _or(c.task, "Extract the most useful structured data from this page.")), Section("PAGE", F.concat(F.lit("Title: "), _or(c.title, ""), F.lit("\nURL: "), _or(c.url, ""), F.lit("\nHeadings: "), _headings(c, MOST["scrape headings"]))),
        Section("PAGE TEXT", text), Section("TABLES", table_texts(c.tables, MOST["scrape tables"], MOST["scrape rows"])),
    )


def history_prompt(task: Column, summary: Column, steps: Column) -> Column:
    """What a summary of the work so far is made from; the summary before, if there is one, goes in."""
    return rendered(Section("TASK", task), Section("PRIOR SUMMARY", summary, T.or_empty(summary) != ""), Section("RECENT STEPS", steps))


def with_last_steps(steps: DataFrame, session: list[str], order: list[str], kind: str = "kind", text: str = "text", out: str = "steps") -> DataFrame:
    """Each step with the last steps of its session up to it, itself included, as ``out``."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(1 - MOST["steps"], 0)
    return steps.withColumn(out, F.collect_list(F.struct(F.col(kind).alias("kind"), F.col(text).alias("text"))).over(w))


def text_first(mode: Column, skills: Column | None) -> Column:
    """Whether a task is about a page's text, so that no image need go with it."""
    own = F.coalesce(mode == "summarize", F.lit(False))
    return own if skills is None else own | F.coalesce(F.exists(skills, lambda s: F.contains(F.lower(T.or_empty(s["id"])), F.lit("summar"))), F.lit(False))


def request(prompt: Column, screenshot: Column, images: Column, include: Column | None = None) -> Column:
    """A struct of prompt, screenshot and images; the latter two are empty where ``include`` isn't true."""
    if include is None:
        return F.struct(prompt.alias("prompt"), screenshot.alias("screenshot"), images.alias("images"))
    return F.struct(prompt.alias("prompt"), F.when(include, screenshot).alias("screenshot"), F.when(include, images).otherwise(F.slice(images, 1, 0)).alias("images"))


def planner_request(c: Context, appendix: Column, screenshot: Column, images: Column) -> Column:
    return request(F.concat_ws("\n\n", plan_prompt(c), appendix), screenshot, images)


def navigator_request(c: Context, appendix: Column, screenshot: Column, images: Column, compact: Column) -> Column:
    """The request for the next action; ``compact`` is the context mode, and a minimal one goes without images."""
    include = ~text_first(c.mode if c.mode is not None else F.lit(""), c.skills) & (F.coalesce(compact, F.lit("normal")) != "minimal")
    return request(F.concat_ws("\n\n", action_prompt(c), appendix), screenshot, images, include)


def cloned_attachments(items: Column) -> Column:
    """Attachments with defaults for what is missing; ``image`` is base64 text."""
    return F.transform(
        items,
        lambda a: F.struct(
            T.first_of(a["id"], F.lit("att")).alias("id"), T.first_of(a["kind"], F.lit("file")).alias("kind"), T.first_of(a["name"], F.lit("attachment")).alias("name"), T.first_of(a["mime_type"], F.lit("application/octet-stream")).alias("mime_type"),
            F.coalesce(a["size"], F.lit(0)).cast("bigint").alias("size"), T.or_empty(a["text"]).alias("text"), F.coalesce(a["truncated"], F.lit(False)).alias("truncated"), T.or_empty(a["image"]).alias("image"),
        ),
    )


def image_attachments(items: Column) -> Column:
    """Name, type and base64 text of the attachments that are images and hold one."""
    own = F.filter(items, lambda a: (a["kind"] == "image") & (T.or_empty(a["image"]) != ""))
    return F.transform(own, lambda a: F.struct(a["name"].alias("name"), T.first_of(a["mime_type"], F.lit("image/jpeg")).alias("mime_type"), a["image"].alias("image")))


def register_skills(skills: DataFrame, prefix: str = "skill_") -> list[str]:
    """Makes a SQL function ``<prefix><id>(task, host)`` of each skill and returns the names.

    It gives the skill's line with the task, or null on a host that the skill does
    not allow. A catalogue of skills is a small dimension written by hand; ids
    are made names by replacing what isn't a letter, digit or underscore, and of
    skills with one name the first by ``pos`` counts.
    """
    spark, names = skills.sparkSession, []
    allowed = F.array_join(F.transform("allowed_hosts", lambda h: F.lower(F.trim(h))), "\n")
    rows = skills.select(F.regexp_replace("id", r"[^A-Za-z0-9_]", "_").alias("id"), skill_lines(F.array(F.struct("id", "name", "prompt", "allowed_hosts", "preferred_sites", "checklist"))).alias("line"), allowed.alias("hosts"), "pos")
    for r in rows.orderBy("pos").collect():
        name = f"{prefix}{r.id}"
        if r.id and name not in names:
            names.append(name)
            line, hosts = (x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") for x in (r.line, r.hosts))
            fits = f"'{hosts}' = '' OR (host <> '' AND exists(split('{hosts}', '\\n'), h -> contains(lower(host), h) OR contains(h, lower(host))))"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(task STRING, host STRING) RETURNS STRING RETURN CASE WHEN {fits} THEN concat('{line}', '\\n', coalesce(task, '')) END")
    return names


