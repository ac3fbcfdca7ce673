"""Sequenced changes, collocations and the line index against plain versions and odd input."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import changes, collocations, line_dedup
from weftline.llm.changes import Client

LOG = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, city string, balance double, segment string"


def plain_changes(rows):
    """The contract as loops: (status, batch, missed, city, cents, current) of each row, by its fields."""
    rows = list(dict.fromkeys(rows))
    ranks = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    own = []
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if r[4] is not None and h % 11:
            day = (r[4].date() - dt.date(1970, 1, 1)).days + 2 * (h % 4)
            n = sorted(ranks[r[1]], key=lambda s: (s is not None, s)).index(r[2]) + 1
            cents = None if r[6] is None or not math.isfinite(r[6]) else math.floor(100 * r[6] + 0.5)
            own.append((max(1, min(8, 1 + math.floor((day - 19723) * 8 / 160))), day, r[0], (r[3] is not None, r[3] or "", r[5] is not None, r[5] or "", cents is not None, cents or 0), r[1], n, r[3], r[5], cents))
    own.sort(key=lambda x: (x[0], x[1], x[2], x[3]))
    state, out, last = defaultdict(lambda: {"next": 1, "held": {}, "city": None, "cents": None}), [], {}

    def apply(c, s, batch, missed):
        r = s["held"].pop(s["next"])
        s["next"] += 1
        if r[6] == "U":
            s["city"], s["cents"] = (s["city"] if r[7] is None else r[7]), (s["cents"] if r[8] is None else r[8])
        elif r[6] in ("I", "D"):
            s["city"], s["cents"] = (r[7], r[8]) if r[6] == "I" else (None, None)
        last[c] = len(out)
        out.append([r[2], c, "applied", batch, missed, s["city"], s["cents"], r[6]])

    def jumps(batch, clock):
        for c, s in state.items():
            while s["held"] and (clock is None or min(r[1] for r in s["held"].values()) + 5 <= clock):
                missed, s["next"] = min(s["held"]) - s["next"], min(s["held"])
                apply(c, s, batch, missed)
                while s["next"] in s["held"]:
                    apply(c, s, batch, 0)

    for batch in range(1, 9):
        if before := [r[1] for r in own if r[0] < batch]:
            jumps(batch, max(before))
        for r in (r for r in own if r[0] == batch):
            s = state[r[4]]
            if r[5] < s["next"] or r[5] in s["held"]:
                out.append([r[2], r[4], "rejected", batch, 0, None, None, "D"])
                continue
            s["held"][r[5]] = r
            while s["next"] in s["held"]:
                apply(r[4], s, batch, 0)
    jumps(9, None)
    return [(*x[:7], last.get(x[1]) == i and x[2] == "applied" and x[7] != "D") for i, x in enumerate(out)]


def test_changes(spark, monkeypatch):
    monkeypatch.setattr(changes, "CHUNK", 16)
    monkeypatch.setattr(changes, "BLOCK", 4)
    monkeypatch.setattr(changes, "INLINE", 3)
    rng, rows = random.Random(5), []
    start = dt.datetime(2023, 12, 20)
    for i in range(420):
        client = rng.choice([7] * 4 + [1, 2, 3, None])
        seq = None if rng.random() < 0.02 else i // 3 * 5 + rng.randrange(-40, 40)
        when = None if rng.random() < 0.04 else start + dt.timedelta(days=max(0, min(170, i * 0.35 + rng.randrange(-4, 12))))
        rows.append((i, client, seq, rng.choice("IUUUDX") if rng.random() < 0.97 else None, when, rng.choice(["a", "b", None]), rng.choice([1.005, -2.5, 17.0, None, float("nan"), float("inf")]), rng.choice("xy")))
    rows += rows[40:60] + [(5, 7, 900, "U", start + dt.timedelta(days=60), "c", 3.0, "x"), (5, 7, 900, "I", start + dt.timedelta(days=60), "c", 3.0, "x")]
    df = spark.createDataFrame(rows, LOG)
    got = changes.applied_changes(df).drop("n")
    assert got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    # rows whose balance isn't finite are equal rows, too
    want = plain_changes([tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows] and [(*r[:6], None if r[6] is not None and not math.isfinite(r[6]) else r[6], (r[7], str(r[6]))) for r in rows])
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=by) == sorted(want, key=by)
    kinds = Counter((r[2], r[4] > 0) for r in want)
    assert min(kinds["applied", False], kinds["applied", True], kinds["rejected", False]) > 5


def test_repeats_and_one_stage(spark, tmp_path, monkeypatch):
    """Of a batch's rows of a number all but the first are repeats; a start keeps state in one stage only."""
    day = dt.datetime(2024, 1, 5)
    rows = [(i, client, 1, "U", day, "a", 1.0, "x") for client in (1, None) for i in (3, 1, 2, 5)] + [(5, 1, 1, "U", day, "a", 1.0, "y")]
    df = spark.createDataFrame(rows, LOG)
    own, numbers = changes.numbered(df)
    got = [(r.client_id, r.day, r.change_id, r.repeat) for r in changes.with_repeats(own).collect()]
    for client in (1, None):
        own = [r for r in got if r[0] == client]
        first = min(r[1:3] for r in own)
        assert all(r[3] == (r[1:3] != first) for r in own) and len(own) == (5 if client else 4)
    changes.discard(numbers)
    monkeypatch.setattr(changes, "shared_dir", lambda spark: str(tmp_path))
    assert Counter(r.status for r in changes.applied_changes(df).collect()) == {"applied": 2, "rejected": 7}
    assert [p.name for p in tmp_path.glob("changes-*/state/state/*") if p.is_dir()] == ["0"]


def test_no_changes(spark):
    assert changes.applied_changes(spark.createDataFrame([], LOG)).count() == 0


def test_a_client_holds_blocks(monkeypatch):
    """Held rows beyond ``INLINE`` go to blocks and come back in order."""
    monkeypatch.setattr(changes, "INLINE", 5)
    monkeypatch.setattr(changes, "BLOCK", 4)
    monkeypatch.setattr(changes, "CHUNK", 8)

    class Map(dict):
        getValue, removeKey = dict.get, dict.pop

        def updateValue(self, k, v):
            self[k] = v

    held, state, got = Map(), None, []
    for part in (range(40, 60), range(10, 40), range(2, 10), range(1, 2)):
        c = Client(3, held, state)
        got += [x[0][0] for x in c.take({n: (n, n, 100 + n, "U", None, None) for n in part})]
        state = c.state()
        assert bool(held) == bool(state[5])
    assert got == list(range(1, 60)) and not held and state[1] == 60
    c = Client(3, held, state)
    list(c.take({n: (n, n, 70 - n // 100, "U", None, None) for n in range(100, 130)}))
    assert c.due() == (69 + changes.PATIENCE) * changes.MS
    assert [x[:2] for x in c.skip(c.due() - 1)] == []
    jumped = list(c.skip(c.due()))
    assert [x[0][0] for x in jumped] == list(range(100, 130)) and [x[1] for x in jumped] == [40] + [0] * 29


def test_dense_numbers(spark):
    rows = [(g, s) for g in (1, None) for s in (None, 5, 5, -3, 9)] + [(2, i // 2) for i in range(3000)]
    got = changes.dense_numbers(spark.createDataFrame(rows, "g bigint, s bigint"), "g", "s")
    assert {(r.g, r.s): r.n for r in got.collect()} == {(g, s): i + 1 for g in (1, None) for i, s in enumerate((None, -3, 5, 9))} | {(2, i): i + 1 for i in range(1500)}


def plain_collocations(docs, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    c = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in c.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in c.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    rng = random.Random(8)
    words = ["the", "Ox", "é b", "NEW", "york", "city", "big", "x1", "don't", "zoo"]
    texts = [("".join(rng.choice(words) + rng.choice([" ", "  ", " \t", ", ", "\n", " "]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None])) for _ in range(120)]
    texts += [("new york city, " * 40, "en"), ("New  York\tcity hall " * 30, "en"), (None, "en"), ("", None), (" .,\n", "fr"), ("word " * 70_000, "xx"), texts[0], texts[0]]
    df = spark.createDataFrame([(*t, 1) for t in texts], "text string, lang string, rank int")
    got = collocations.collocations(df, least=8, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(texts, 8, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocations_through_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 10)  # lets nearly all phrases through to the exact count
    rng = random.Random(2)
    texts = [(" ".join(f"w{rng.randrange(40)}" for _ in range(300)), "en") for _ in range(40)]
    got = collocations.collocations(spark.createDataFrame(texts, "text string, lang string"), least=12)
    assert sorted(map(tuple, got.collect())) == plain_collocations(texts, 12)


def test_texts_of_phrases():
    """The texts of all n-grams at once are those of their words one by one."""
    own = ["A  b\tÉ c.D", "", None, ". ,", "日本 X\x1fY  z", "one"]
    w = collocations.Words(pa.array(own), ["en", "en", "de", "fr", "en", "de"])
    w.spaced()
    for k in range(1, 5):
        want = []
        for text in own:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                words = re.findall(r"[^\x20\x09]+", piece)
                want += [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert w.texts(np.flatnonzero(w.whole())).to_pylist() == want
        w.longer()


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    k1, k2 = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    f = line_dedup.Cuckoo.of_size(3000)
    assert not f.insert(k1, k2).any() and f.has(k1, k2).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert f.has(*other).mean() < 0.01
    assert not f.delete(k1[:1500], k2[:1500]).any()
    assert f.has(k1[1500:], k2[1500:]).all() and f.has(k1[:1500], k2[:1500]).mean() < 0.01
    assert (f.table != 0).sum() == 1500
    full = line_dedup.Cuckoo.of_size(100)
    failed = full.insert(k1, k2)
    assert failed.any() and full.has(k1[~failed], k2[~failed]).all()  # what found no place took none from others
    several = line_dedup._changed([], k1, k2, np.zeros(3000, bool))
    several = line_dedup._changed(several, *rng.integers(-(2**63), 2**63 - 1, (2, 9000)), np.zeros(9000, bool))
    assert len(several) > 1 and np.any([f.has(k1, k2) for f in several], axis=0).all()


def plain_lines(docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first, own = {}, defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                own[key(x)].add(i)
    first = {k: min(v) for k, v in own.items() if len(v) > 1}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_docs(seed, n, at=0):
    rng = random.Random(seed)
    pool = ["A shared line of text", "  a SHARED line of text\t", "exactly 10", "exactly 9", "", "éééééééééé", "another one of these", " \x0b\x0c\r"]
    return [(at + i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own line {rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12)))) for i in range(n)]


def test_line_dedup(spark):
    docs = [*some_docs(1, 60), (70, None), (71, ""), (72, "\n".join(["a shared line of text"] * 3)), (73, "twice in here\ntwice in here"), (None, "A shared line of text\nx"), (5, some_docs(1, 60)[5][1]), (74, "exactly 10\n" * 20_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, k1 int")
    out = line_dedup.index_of(df).dedup(df)
    assert out.columns == ["doc_id", "text", "k1", "n_lines", "n_dropped", "kept"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
    assert got == plain_lines(docs)
    assert line_dedup.index_of(df.limit(0)).dedup(df.limit(0)).count() == 0


def test_line_index_forth_and_back(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_SHARD", 40)
    one, two = some_docs(1, 40), some_docs(2, 40, 40)
    frame = lambda d: spark.createDataFrame(d, "doc_id bigint, text string")
    state = lambda x: sorted((r.k1, r.k2, r.refs, r.first) for r in x.refs.collect())
    texts = lambda x, d: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in x.dedup(frame(d)).collect()), key=str)
    first = line_dedup.index_of(frame(one))
    both = first.insert(frame(two))
    assert state(both) == state(line_dedup.index_of(frame(one + two))) and texts(both, one + two) == plain_lines(one + two)
    back = both.delete(frame(two).select("doc_id"))
    assert state(back) == state(first) and texts(back, one) == plain_lines(one)
    rest = both.delete(frame(one[:25]).select("doc_id"))
    assert texts(rest, one[25:] + two) == plain_lines(one[25:] + two)
    none = back.delete(frame(one).select("doc_id"))
    assert not state(none) and not none.lines.count()
    # filters hold what the exact tables hold, one entry a key
    for index in (both, back, rest, none):
        for filters, least in ((index.in_use, 1), (index.shared, 2)):
            held = sum(int((f.table != 0).sum()) for r in filters.collect() for f in line_dedup._loaded(r.tables))
            assert held == index.refs.where(F.col("refs") >= least).count()


def test_lines_without_small_filters(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    docs = some_docs(3, 50)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.index_of(df).dedup(df).collect()), key=str)
    assert got == plain_lines(docs)
    assert hashlib.sha256(got[0][3].encode()).hexdigest()
