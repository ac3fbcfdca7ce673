"""Secret scans by a trigram index.

Every rule is a regular expression. From its syntax tree a Boolean query over
trigrams is derived that each matching text must satisfy; the postings of those
trigrams are intersected and united, and only the remaining candidates are
verified by the expression. A rule without mandatory trigrams scans every text.

The index is partitioned by document: each task builds the postings of its own
block of rows, so there is no shuffle and nothing grows with the corpus. A block
holds postings for the trigrams that some rule asks for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as sre, _parser

from .common import joined_bytes, slices

#: A query in disjunctive form: a set of alternatives, each a set of trigrams that must all occur.
Query = frozenset
EVERYTHING: Query = frozenset([frozenset()])
#: Sets of literals beyond this size are not followed further.
MOST_LITERALS = 48


@dataclass(frozen=True)
class Rule:
    """``least``: characters of ``group`` below which a match is dropped (after matching, no retry)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The patterns of the secrets to find, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\r?\n[A-Za-z]+-[A-Za-z]+:[^\n]*)*(?:[\x20\r\n]*[A-Za-z0-9+/=]{16,})*(?:[\x20\r\n]*[A-Za-z0-9+/=]*[\x20\r\n]*-----END [A-Z ]*PRIVATE KEY-----)?", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
BASE_KINDS = ("assign", "access", "hex")


def simplest(alternatives) -> Query:
    """Without alternatives that ask for more than another one does."""
    kept: list[frozenset] = []
    for a in sorted(set(alternatives), key=len):
        if not any(k <= a for k in kept):
            kept.append(a)
    return frozenset(kept)


def both(a: Query, b: Query) -> Query:
    out = simplest(x | y for x in a for y in b)
    return out if len(out) <= 4 * MOST_LITERALS else a


def trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def of_literals(strings: frozenset[str]) -> Query:
    """What texts must hold if they contain one of the strings."""
    return simplest(trigrams(s) for s in strings)


def _class_chars(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset[str] | None, Query]:
    """The finite set of strings a tree matches (None if not finite), and its query."""
    run: frozenset[str] = frozenset([""])
    exact, query = True, EVERYTHING

    def close() -> None:
        nonlocal run, exact, query
        query, run, exact = both(query, of_literals(run)), frozenset([""]), False

    def extend(more: frozenset[str]) -> None:
        nonlocal run
        if len(run) * len(more) > MOST_LITERALS:
            close()
        run = frozenset(a + b for a in run for b in more) if len(more) <= MOST_LITERALS else frozenset([""])

    for op, arg in tree:
        if op is sre.LITERAL:
            extend(frozenset([chr(arg).lower()]))
        elif op is sre.IN and (chars := _class_chars(arg)):
            extend(frozenset(c.lower() for c in chars))
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            parts = [_walk(arg[3])] if op is sre.SUBPATTERN else [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                extend(frozenset().union(*(p[0] for p in parts)))
            else:
                close()
                query = both(query, simplest(frozenset().union(*(q if s is None else of_literals(s) for s, q in parts))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, q = _walk(inner)
            if most == 1 and strings is not None:
                extend(strings | {""} if least == 0 else strings)
            elif least >= 1:
                if strings is not None:
                    extend(strings)
                    close()
                else:
                    close()
                    query = both(query, q)
            else:
                close()
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            close()
    if exact:
        return run, of_literals(run)
    return None, both(query, of_literals(run))


def trigram_query(pattern: str) -> Query:
    """The query that every text matching ``pattern`` satisfies, over lower-cased (A-Z) trigrams.

    ``EVERYTHING`` if nothing is mandatory. Trigrams with characters beyond ASCII are left out.
    """
    query = _walk(_parser.parse(pattern))[1]
    return simplest(frozenset(t for t in alt if t.isascii()) for alt in query)


class Block:
    """The inverted index of one block of texts, for the trigrams in ``wanted``."""

    def __init__(self, texts: pa.Array, table: np.ndarray, wanted: list[str]):
        buf, off = joined_bytes(texts)
        self.rows = len(texts)
        low = np.frombuffer(buf.tobytes().lower(), np.uint8).astype(np.uint32)
        self.postings: dict[str, np.ndarray] = {t: np.zeros(0, np.int64) for t in wanted}
        if len(low) < 3:
            return
        which = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(which)
        row = np.searchsorted(off, at, "right") - 1
        whole = off[row + 1] >= at + 3
        at, row = at[whole], row[whole]
        pairs = np.unique(which[at].astype(np.int64) * (self.rows + 1) + row)
        ids, rows = pairs // (self.rows + 1), pairs % (self.rows + 1)
        cut = np.searchsorted(ids, np.arange(1, len(wanted) + 2))
        for i, t in enumerate(wanted):
            self.postings[t] = rows[cut[i] : cut[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that satisfy the query; all of them for a query without mandatory trigrams."""
        if frozenset() in query:
            return np.arange(self.rows)
        hits = []
        for alt in query:
            lists = sorted((self.postings[t] for t in alt), key=len)
            hits.append(reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists))
        return reduce(np.union1d, hits, np.zeros(0, np.int64)).astype(np.int64)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_TABLES: dict[tuple, np.ndarray] = {}


def _table(wanted: list[str]) -> np.ndarray:
    """Trigram code to 1 + place in ``wanted``; made once in each worker (16 MB)."""
    key = tuple(wanted)
    if key not in _TABLES:
        t = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for i, g in enumerate(wanted):
            a, b, c = g.encode()
            t[a << 16 | b << 8 | c] = i + 1
        _TABLES[key] = t
    return _TABLES[key]


def find_in(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[dict]]:
    """The spans of each text, ordered by start, then by the order of the rules."""
    plans = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
    wanted = sorted(set().union(*(alt for _, _, q in plans if frozenset() not in q for alt in q)))
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    for i, j in slices(texts):
        part = texts.slice(i, j - i)
        block = Block(part, _table(wanted), wanted)
        strings = part.to_pylist()
        for k, (rule, rx, query) in enumerate(plans):
            for row in block.candidates(query).tolist():
                if text := strings[row]:
                    for m in rx.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[i + row].append((m.start(), k, m.end()))
    return [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in out]


def secret_spans(text: str | Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of secrets in a text column: kind, start and end in code points, end exclusive.

    A null or empty text gives an empty array.
    """

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(find_in(texts, rules), kind)

    return spans.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the spans of the secrets in each text in column ``out``.

    Rows stay as they are, repeated ones too; any other column passes through. A
    column already named ``out`` is replaced. Null and empty texts have no spans,
    an empty table gives an empty one. Whole texts are scanned, whatever their length.
    """
    return docs.withColumn(out, secret_spans(text, rules))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark.

    Texts without secrets, null and empty ones come back unchanged.
    """

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        found = find_in(texts, rules)
        if not any(found):
            return texts
        out = texts.to_pylist()
        for i, spans in enumerate(found):
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [out[i][at : s["start"]], mark]
                    at = max(at, s["end"])
                out[i] = "".join([*parts, out[i][at:]])
        return pa.array(out, texts.type)

    return docs.withColumn(text, cleaned(F.col(text)))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
