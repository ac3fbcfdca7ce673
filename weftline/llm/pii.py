"""Personal data by patterns and by information-theoretic sanitisation.

Patterns find the protected entities: e-mail addresses, IP addresses, card and
phone numbers. Corpus co-occurrence then estimates how strongly other terms
reveal one of them (Sanchez and Batet, 2016): with lines as units, the pointwise
mutual information PMI(c; t) = log2(N n_ct / (n_c n_t)) of an entity c and a term
t is compared with the entity's information IC(c) = log2(N / n_c). A term that
gives away ``alpha`` or more of it is generalised or removed where it stands
beside the entity.

DataFrame functions only; texts are never shuffled, and what is counted is
restricted early to lines with an entity and to the terms in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, spread_join

# The patterns of personal data, in the order in which kinds are listed. Possessive
# groups and \G keep them linear on long runs; they match what the plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for (a plain search is cheaper than the pattern), beside digits.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
IP_PART = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
WORD = r"[\p{L}\p{N}_]+"
KINDS = (*PATTERNS, "term")


#: Matches that are gathered by appending one to the other; more are gathered in chunks of as many.
CHUNK = 256
#: Copies of a text up to which they may meet in one task.
HOT_ROWS = 1000


def matches(text: Column, pattern: str) -> Column:
    """``start``, ``end`` (code points) and ``value`` of the leftmost non-overlapping matches."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        full = F.size(acc["out"]) >= CHUNK
        out = F.when(x["hit"].isNull(), acc["out"]).when(full, one).otherwise(F.concat(acc["out"], one))
        return F.struct(end.alias("at"), out.alias("out"), F.when(full & x["hit"].isNotNull(), F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"]).alias("done"))

    # coalesce makes the types nullable, as those of the steps are
    empty = F.coalesce(F.lit(None).cast(kind), F.array().cast(kind))
    nothing = F.coalesce(F.lit(None).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out"), nothing.alias("done")), step, lambda acc: F.concat(F.flatten(acc["done"]), acc["out"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(IP_PART))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """``kind``, ``start``, ``end`` and ``value`` of the pattern matches, by kind as listed, then start."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    found = []
    for kind, pattern in PATTERNS.items():

        def held(m: Column, kind: str = kind) -> Column:
            return _holds(kind, m["value"])

        def named(m: Column, kind: str = kind) -> Column:
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))

        own = F.transform(F.filter(matches(text, pattern), _unary(held)), _unary(named))
        found.append(F.when(F.contains(text, F.lit(NEEDS[kind])) & text.rlike(pattern), own).otherwise(empty))
    return F.when(text.rlike("[0-9]"), F.concat(*found)).when(F.contains(text, F.lit("@")), found[0]).otherwise(empty)


def _unary(f):
    return lambda x: f(x)


def entity(span: Column) -> Column:
    """What a span stands for: its kind and value without case or punctuation."""
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _outside(line: Column, spans: Column) -> Column:
    """The line with a blank for each character of the spans, so that word places stay."""
    return F.aggregate(spans, line, lambda acc, s: F.overlay(acc, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def terms_of(line: Column) -> Column:
    """The distinct lower-cased words of a line, of 3 letters or more."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 3), lambda w: F.lower(w)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def disclosing(docs: DataFrame, text: str = "text", alpha: float = 0.8, support: int = 3) -> DataFrame | None:
    """Entity ``c`` and term ``t`` where the term reveals the entity; None if no term can.

    Units are the lines of all texts. A pair needs ``support`` distinct contexts
    (the line's terms outside its entities, in order), so that copies of one
    passage are no evidence, however many there are.
    """
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    holders = plain.where(F.size(base_spans(F.col("t"))) > 0)
    holding = holders.select(F.explode(lines_of(F.col("t"))).alias("line"))
    holding = holding.where(F.size(base_spans(F.col("line"))) > 0).groupBy("line").agg(F.count("*").alias("n"))
    spotted = holding.withColumn("s", base_spans(F.col("line"))).withColumn("rest", _outside(F.col("line"), F.col("s")))
    each = spotted.select("n", terms_of(F.col("rest")).alias("terms"), F.explode("s").alias("e"))
    each = settle(each.select("n", "terms", entity(F.col("e")).alias("c"), F.xxhash64("terms").alias("ctx")), "entity-lines")
    known = each.groupBy("c").agg(F.sum("n").alias("n_c"), F.count_distinct("ctx").alias("contexts"), F.count("*").alias("rows_of_key")).where(F.col("contexts") >= support)
    known = settle(known.select("c", "n_c", "rows_of_key"), "entities")
    # an entity on very many lines, such as a support address, isn't gathered in one task
    pairs = spread_join(each, known, "c", each.count()).select("c", "n_c", "n", "ctx", F.explode("terms").alias("t"))
    pairs = pairs.groupBy("c", "n_c", "t").agg(F.sum("n").alias("n_ct"), F.count_distinct("ctx").alias("contexts")).where(F.col("contexts") >= support)
    pairs = settle(pairs.select("c", "n_c", "t", "n_ct"), "pairs")
    discard(each, known)
    if pairs.isEmpty():
        return None
    total = float(plain.agg(F.sum(F.size(lines_of(F.col("t"))))).first()[0])
    # PMI >= alpha IC means n_t <= n_ct (N / n_c)^(1 - alpha). The texts that hold an entity give a lower
    # bound of n_t, which rules out common words, so that only rare ones are counted in the whole corpus.
    most = F.col("n_ct") * F.pow(F.lit(total) / F.col("n_c"), F.lit(1 - alpha)) * (1 + 1e-9)
    near = _term_lines(holders).groupBy("t").agg(F.count("*").alias("n_near"))
    rare = settle(pairs.join(near, "t", "left").where(F.coalesce("n_near", F.lit(0)) <= most).drop("n_near"), "rare-pairs")
    discard(pairs)
    if rare.isEmpty():
        return None
    seen = _term_lines(plain).join(rare.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n_t"))
    pmi = F.log2(F.col("n_ct") * total / (F.col("n_c") * F.col("n_t")))
    ic = F.log2(total / F.col("n_c"))
    out = settle(rare.join(seen, "t").where((ic > 0) & (pmi >= alpha * ic)).select("c", "t"), "disclosing")
    discard(rare)
    return out


def _term_lines(plain: DataFrame) -> DataFrame:
    """A row, ``t``, for each line of the texts and each of its terms."""
    return plain.select(F.explode(lines_of(F.col("t"))).alias("line")).select(F.explode(terms_of(F.col("line"))).alias("t"))


def _term_spans(text: Column, lines: Column) -> Column:
    """Places of the terms in ``lines`` (array of line number, terms) within the text."""
    whole = lines_of(text)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of_line(x: Column) -> Column:
        base = F.aggregate(F.slice(whole, F.lit(1), x["no"]), F.lit(0), lambda acc, line: acc + F.length(line) + 1)
        line = F.element_at(whole, x["no"] + 1)
        free = _outside(line, base_spans(line))
        hits = F.filter(matches(free, WORD), lambda m: F.array_contains(x["terms"], F.lower(m["value"])))
        return F.transform(hits, lambda m: F.struct(F.lit("term").alias("kind"), (m["start"] + base).alias("start"), (m["end"] + base).alias("end"), m["value"].alias("value")))

    return F.coalesce(F.array_sort(F.flatten(F.transform(lines, of_line))), empty)


def scan(docs: DataFrame, text: str = "text", out: str = "pii", alpha: float = 0.8, support: int = 3) -> DataFrame:
    """``docs`` with the spans of personal data in each text in column ``out``: kind, start, end, value.

    Spans are ordered by kind (email, ip, card, phone, term), then start; places
    are code points, ends exclusive. Pattern spans always stay; terms that
    disclose an entity are added on the lines where it stands. Null and empty
    texts have none. Every row comes back once, in any order; other columns pass
    through and one named ``out`` is replaced. An empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn(out, base_spans(t))
    pairs = disclosing(docs, text, alpha, support)
    if pairs is None:
        return marked
    tag = f"_{uuid.uuid4().hex}"
    entities = docs.select(t.alias("t")).where(F.size(base_spans(F.col("t"))) > 0).select(F.xxhash64("t").alias("th"), F.posexplode(lines_of(F.col("t"))).alias("no", "line"))
    entities = settle(entities.select("th", "no", F.explode(base_spans(F.col("line"))).alias("e")).select("th", "no", entity(F.col("e")).alias("c")), "entities")
    copies = entities.groupBy("c").agg(F.count("*").alias("rows_of_key"))
    revealed = pairs.groupBy("c").agg(F.collect_set("t").alias("ts")).join(copies, "c")
    told = spread_join(entities, revealed, "c", entities.count())
    told = told.select("th", "no", F.explode("ts").alias("t")).groupBy("th", "no").agg(F.sort_array(F.collect_set("t")).alias("terms"))
    told = told.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("no", "terms"))).alias(f"lines{tag}")).withColumnRenamed("th", f"th{tag}")
    keyed = marked.withColumn(f"of{tag}", F.when(F.size(out) > 0, F.xxhash64(t)))
    # only texts with an entity meet the join; the others pass by, and the copies of a frequent text stay where they are
    own = keyed.where(F.col(f"of{tag}").isNotNull())
    copies = own.groupBy(f"of{tag}").agg(F.count("*").alias("rows_of_key"))
    told = settle(copies.join(told, F.col(f"of{tag}") == F.col(f"th{tag}"), "left").drop(f"th{tag}"), "told")
    discard(entities, pairs)
    own = spread_join(own, told, f"of{tag}", told.agg(F.sum("rows_of_key")).first()[0] or 0, HOT_ROWS, keep=False)
    lines = F.col(f"lines{tag}")
    own = own.withColumn(out, F.when(lines.isNull(), F.col(out)).otherwise(F.concat(F.col(out), _term_spans(t, lines))))
    names = [F.col(f"`{c}`") for c in marked.columns]
    return own.select(*names).union(keyed.where(F.col(f"of{tag}").isNull()).select(*names))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with personal data generalised in ``text``.

    A pattern match becomes its kind in brackets, a disclosing number
    ``[NUMBER]``, a disclosing capitalised word ``[NAME]``, and any other
    disclosing word is removed. Overlapping spans become what the first of them
    becomes. Texts without personal data come back unchanged, null stays null;
    rows, repeated ones too, and other columns stay as they are.
    """
    own = f"pii_{uuid.uuid4().hex}"
    found = scan(docs, text, own, **options)
    t = F.coalesce(F.col(text), F.lit(""))

    def mark(s: Column) -> Column:
        word = F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(s["kind"] == "term", word).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark"))))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, F.concat(acc["out"], gap, s["mark"])).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size(own) > 0, clean).otherwise(F.col(text))).drop(own)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
