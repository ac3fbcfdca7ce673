"""Datasets of unlike rows, their columns, and their rendering as CSV, text, Markdown and JSON.

A dataset's row is a map from column to text with its place ``pos`` and the
order of its ``keys``. Renderings are built row by row with column expressions;
only the final text of one dataset is gathered.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FORMATS = ("json", "csv", "txt", "md")


def normalized_formats(formats: Column) -> Column:
    """The known formats named, lower-cased, each once in order; ``json`` if there is none."""
    known = F.array_distinct(F.filter(F.transform(formats, lambda x: F.lower(x)), lambda x: x.isin(*FORMATS)))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("json")))


def file_segment(c: Column, default: str = "export") -> Column:
    """A part of a file name: illegal characters and blanks as hyphens, at most 80 characters."""
    clean = T.normalize(F.regexp_replace(T.or_empty(c), r'[<>:"/\\|?*\x00-\x1f]', " "))
    return F.coalesce(F.nullif(F.substring(F.replace(clean, F.lit(" "), F.lit("-")), 1, 80), F.lit("")), F.lit(default))


def base_name(c: Column) -> Column:
    """A short lower-case name for an export (empty if nothing is left)."""
    s = F.regexp_replace(T.or_empty(c), r"[^A-Za-z0-9_\s-]+", " ")
    return F.lower(F.substring(F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")), 1, 60))


def csv_cell(c: Column, always: bool = True) -> Column:
    """A CSV cell; quoted always, or only where its content asks for it."""
    s = T.or_empty(c.cast("string"))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(s.rlike('[",\n]'), quoted).otherwise(s)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(T.or_empty(c.cast("string")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _lines(rows: DataFrame, line: Column, pos: str) -> DataFrame:
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))), lambda x: x["l"]).alias("lines"))


def csv_text(rows: DataFrame, columns: list[str], pos: str, always: bool = True) -> DataFrame:
    """One row, ``content``: header and rows as CSV, CRLF between them (LF if cells are quoted only where needed), none at the end."""
    line = F.concat_ws(",", *[csv_cell(F.col(c), always) for c in columns])
    head = F.concat_ws(",", *[csv_cell(F.lit(c), always) for c in columns])
    return _lines(rows, line, pos).select(F.array_join(F.concat(F.array(head), "lines"), "\r\n" if always else "\n").alias("content"))


def markdown_text(rows: DataFrame, columns: list[str], pos: str, title: str = "", summary: str = "", compat: bool = True) -> DataFrame:
    """One row, ``content``: title, summary and table. ``compat`` puts a blank line between all parts, table rows included."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |"))
    head = [F.lit(f"| {' | '.join(columns)} |"), F.lit(f"| {' | '.join('---' for _ in columns)} |")]
    top = [F.lit(x) for x in ([f"# {title}"] if title else []) + ([summary] if summary else [])]
    out = _lines(rows, line, pos)
    if compat:
        return out.select(F.array_join(F.concat(F.array(*top, *head), "lines"), "\n\n").alias("content"))
    return out.select(F.array_join(F.array(*top, F.array_join(F.concat(F.array(*head), "lines"), "\n")), "\n\n").alias("content"))


def plain_text(rows: DataFrame, columns: list[str], pos: str, title: str = "", summary: str = "") -> DataFrame:
    """One row, ``content``: title, summary, columns and numbered JSON rows."""
    numbered = F.to_json(F.struct(*columns))
    out = _lines(rows, numbered, pos)
    body = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    top = ([title] if title else []) + (["", summary] if summary else []) + ["", f"Columns: {', '.join(columns)}", "", "Rows:"]
    return out.select(F.trim(F.array_join(F.concat(F.array(*map(F.lit, top)), body), "\n")).alias("content"))


def labelled_text(rows: DataFrame, columns: list[str], pos: str, title: str, notes: list[str] | None = None) -> DataFrame:
    """One row, ``content``: title, notes and numbered ``column: value`` lines."""
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), T.normalize(F.col(c).cast("string"))) for c in columns])
    top = [f"Title: {title}", *([f"Notes: {' | '.join(notes)}"] if notes else []), ""]
    body = F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return _lines(rows, line, pos).select(F.array_join(F.concat(F.array(*map(F.lit, top)), body), "\n").alias("content"))


def json_rows(rows: DataFrame, columns: list[str], pos: str, pretty: bool = False) -> DataFrame:
    """One row, ``content``: the rows as a JSON array, compact or indented by two blanks (columns of plain values)."""
    if not pretty:
        return _lines(rows, F.to_json(F.struct(*columns)), pos).select(F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("content"))

    def value(c: str) -> Column:
        one = F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f"    {json.dumps(c, ensure_ascii=False)}: "), F.substring(one, F.lit(6), F.length(one) - 6))

    line = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *map(value, columns)), F.lit("\n  }"))
    body = F.concat(F.lit("[\n"), F.array_join("lines", ",\n"), F.lit("\n]"))
    return _lines(rows, line, pos).select(F.when(F.size("lines") > 0, body).otherwise("[]").alias("content"))


def rendered(rows: DataFrame, columns: list[str], pos: str, form: str, title: str = "", summary: str = "") -> DataFrame:
    """The dataset in one of the formats; unknown ones are JSON, ``markdown`` is ``md``."""
    form = form.lower()
    if form == "csv":
        return csv_text(rows, columns, pos)
    if form == "txt":
        return plain_text(rows, columns, pos, title, summary)
    if form in ("md", "markdown"):
        return markdown_text(rows, columns, pos, title, summary)
    return json_rows(rows, columns, pos)


def inferred_columns(rows: DataFrame, keys: str = "keys", pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """The distinct keys of the rows (of each ``by`` group) in order of first appearance: ``column``, ``place`` from 1."""
    from pyspark.sql import Window

    by = by or []
    each = rows.select(*by, F.col(pos).alias("__p"), F.posexplode(keys).alias("__k", "column"))
    first = each.groupBy(*by, "column").agg(F.min(F.struct("__p", "__k")).alias("first"))
    w = Window.partitionBy(*by).orderBy("first") if by else Window.orderBy("first")
    return first.select(*by, "column", F.row_number().over(w).alias("place"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Rows of unlike tables as one, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fallback_dataset(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The rows a page gives without a model: up to 12 headings, then up to 20 links, in order, then cells of ``tables``, where there are any."""
    heads = pages.select("page_id", "url", F.posexplode(F.slice("headings", 1, 12)).alias("p", "value")).select("page_id", F.lit(0).alias("section"), (F.col("p") + 1).alias("pos"), F.lit("heading").alias("type"), "value", "url")
    own = links.where("pos <= 20").select("page_id", F.lit(1).alias("section"), "pos", F.lit("link").alias("type"), "text", "href", "url")
    cells = [table_rows(pages)] if "tables" in pages.columns else []
    return concatenated([heads, own, *cells])


def export_files(rows: DataFrame, columns: list[str], pos: str, name: str, formats: list[str], folder: str, title: str = "", summary: str = "") -> DataFrame:
    """Writes the dataset once a format into text files under ``folder`` and returns the log: place, format, filename.

    Unknown formats count as JSON, and a format named twice is written once. A
    file is a folder of one part, as Spark writes it; it replaces an older one.
    """
    spark = rows.sparkSession
    kinds = list(dict.fromkeys({"markdown": "md"}.get(f.lower(), f.lower() if f.lower() in FORMATS else "json") for f in formats or ["json"]))
    for form in kinds:
        rendered(rows, columns, pos, form, title, summary).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/{name}.{form}")
    return spark.createDataFrame([(i, form, f"{name}.{form}") for i, form in enumerate(kinds, 1)], "place int, format string, filename string")


def table_rows(pages: DataFrame, tables: int = 2, most: int = 8) -> DataFrame:
    """The first rows of the first tables of readable pages, as cells by column name (``Column 1`` and so on)."""
    own = pages.select("page_id", "url", F.posexplode(F.slice("tables", 1, tables)).alias("t", "rows"))
    own = own.select("page_id", "url", "t", F.posexplode(F.slice("rows", 1, most)).alias("r", "cells"))
    names = F.transform("cells", lambda _, i: F.concat(F.lit("Column "), (i + 1).cast("string")))
    return own.select("page_id", "url", F.lit(2).alias("section"), (F.col("t") * most + F.col("r") + 1).alias("pos"), F.map_from_arrays(names, "cells").alias("cells"))
