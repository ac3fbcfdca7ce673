"""DuckDB counterparts of the column functions, as SQL text."""

from __future__ import annotations

from ..functions import text as T
from ..functions import urls as U


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def first_of(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def normalize(x: str) -> str:
    return f"trim({sub(or_empty(x), T.SPACE + '+', ' ')})"


def for_matching(x: str, drop_prefix: bool = False) -> str:
    low = f"lower({or_empty(x)})"
    low = sub(low, "^text:", "") if drop_prefix else low
    return normalize(sub(low, r"[^\p{L}\p{N}\s]", " "))


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def key_words(x: str) -> str:
    stop = ", ".join(lit(w) for w in T.STOP_WORDS)
    return f"list_filter({words(x)}, lambda w: length(w) > 2 AND w NOT IN ({stop}))"


def overlap_of_larger(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END)"


def overlap_of_first(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END)"


def length_ratio(a: str, b: str) -> str:
    x, y = f"length({or_empty(a)})", f"length({or_empty(b)})"
    return f"(CASE WHEN {x} = 0 OR {y} = 0 THEN 0.0e0 ELSE least({x}, {y})::DOUBLE / greatest({x}, {y}) END)"


def found_sorted(x: str, pattern: str) -> str:
    """The distinct normalised matches in sorted order, joined by a bar."""
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({or_empty(x)}, {lit(pattern)}), lambda m: {normalize('m')}))), '|')"


def host_of(x: str) -> str:
    return sub(f"lower(regexp_extract(trim({or_empty(x)}), {lit(U.AUTHORITY)}, 1))", "^www[.]", "")


def normalize_host(x: str) -> str:
    raw = f"trim({or_empty(x)})"
    whole = f"(CASE WHEN contains({raw}, '://') THEN {raw} ELSE 'https://' || {raw} END)"
    plain = sub(sub(raw, "(?i)^https?://", ""), "(?i)^www[.]", "")
    return f"(CASE WHEN {raw} = '' THEN '' WHEN {host_of(whole)} <> '' THEN {host_of(whole)} ELSE lower(trim(string_split({plain}, '/')[1])) END)"


def rows(columns: str, *values: str) -> str:
    """A table of literal rows, as SQL that both engines read."""
    return f"SELECT * FROM (VALUES {', '.join(values)}) AS t({columns})"
