"""Benchmark decontamination by the CGK random-walk embedding.

The embedding (Chakraborty, Goldenberg and Koucky, 2016) copies a word sequence
symbol by symbol; after each step a random bit, drawn from the step and the
symbol, says whether to move on. Sequences at small edit distance walk apart at
an edit and soon fall into step again, so edit distance becomes Hamming distance
and bit-sampling LSH applies: keys of a few sampled steps, over several walks,
as many as the target recall asks for. Windows of an item's size are looked up
in the table of that size, and candidates are verified by exact edit distance.

Windows start where a text can match at all: of the e + 1 pieces an item is cut
into, e edits leave one intact, so a window within e edits holds a piece in its
place. That test loses nothing and is one hash lookup for each word of the text.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_bytes, settle, slices
from .words import A, M, mix, words_of

#: Bytes of text that are taken at once; a longer text is taken alone.
SLICE = 1 << 19
#: Items that are searched for in one pass over the texts.
ITEMS_AT_ONCE = 20_000


def edits(n: int, least: float) -> int:
    """Edits that a passage of n words may differ by at similarity ``least``."""
    return int(math.floor(n * (1 - least) + 1e-9))


class Index:
    """Pieces and LSH tables of the items; ``items``: (id, word hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: float, samples: int, walks: int, keys: int, seed: int = 7):
        self.items, self.least, self.seed = items, least, seed
        self.steps: dict[int, np.ndarray] = {}
        self.walks, self.keys, self.samples = walks, keys, samples
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        by_size: dict[int, list[int]] = {}
        for at, (_, h) in enumerate(items):
            n = len(h)
            e = edits(n, least)
            by_size.setdefault(n, []).append(at)
            cuts = [n * i // (e + 1) for i in range(e + 2)]
            q = min(b - a for a, b in zip(cuts, cuts[1:], strict=False))
            for a in cuts[:-1]:
                pieces.setdefault(q, []).append((int(self.gram(h[a : a + q], q)[0]), at, a))
        self.pieces = {}
        for q, rows in pieces.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.pieces[q] = (seen, hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.tables = {}
        for n, members in by_size.items():
            rng = np.random.default_rng([seed, n])
            self.steps[n] = np.sort(rng.integers(0, 2 * n, (walks, keys, samples)), axis=2)
            k = self.walk(np.stack([items[i][1] for i in members]), n)
            self.tables[n] = []
            for r in range(k.shape[1]):
                order = np.argsort(k[:, r], kind="stable")
                self.tables[n].append((k[order, r], np.array(members)[order]))

    @staticmethod
    def gram(h: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - q + 1), np.uint64)
        for j in range(q):
            out = out * np.uint64(A) + h[j : j + len(out)]
        return mix(out)

    def walk(self, x: np.ndarray, n: int) -> np.ndarray:
        """The LSH keys of sequences of n symbols (rows of ``x``, 0 beyond a sequence's end)."""
        rows = np.arange(len(x))
        x = np.concatenate([x, np.zeros((len(x), 1), np.uint64)], axis=1)
        out = np.zeros((len(x), self.walks * self.keys), np.uint64)
        for r in range(self.walks):
            at = np.zeros(len(x), np.int64)
            wanted: dict[int, list[int]] = {}
            for j, steps in enumerate(self.steps[n][r]):
                for s in steps.tolist():
                    wanted.setdefault(s, []).append(j)
            for s in range(max(wanted) + 1):
                symbol = x[rows, np.minimum(at, n)]
                for j in wanted.get(s, ()):
                    c = r * self.keys + j
                    out[:, c] = mix(out[:, c] * np.uint64(A) + symbol + np.uint64(1))
                step = np.uint64((self.seed * 1_000_003 + r * 7919 + s) * M & ((1 << 64) - 1))
                at += (mix(symbol ^ step) >> np.uint64(63)).astype(np.int64)
        return out

    def search(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches as (item place, first word, end word, distance); ``row``: the text each word belongs to, ascending."""
        if not len(h):
            return []
        starts, sizes = [], []
        lengths = np.array([len(x[1]) for x in self.items])
        lo, hi = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
        for q, (seen, hashes, item, place) in self.pieces.items():
            g = self.gram(h, q)
            at = np.flatnonzero(seen[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            a, b = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
            hit = (b > a) & (row[at] == row[at + q - 1])
            at, a, b = at[hit], a[hit], b[hit]
            which = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            at = np.repeat(at, b - a)
            n = lengths[item[which]]
            roomy = hi[at] - lo[at] >= n - np.floor(n * (1 - self.least) + 1e-9)
            starts.append(np.maximum(at - place[which], lo[at])[roomy])
            sizes.append(n[roomy])
        start, size = np.concatenate(starts), np.concatenate(sizes)
        out: dict[tuple[int, int, int], int] = {}
        for n in np.unique(size).tolist():
            for some in np.array_split(np.unique(start[size == n]), max(1, math.ceil((size == n).sum() / 4096))):
                if len(some):
                    self._match(h, lo, hi, some, n, out)
        return [(i, a, b, d) for (i, a, b), d in out.items()]

    def _match(self, h, lo, hi, start: np.ndarray, n: int, out: dict) -> None:
        at = start[:, None] + np.arange(n)
        end = np.minimum(hi[start], start + n)
        x = np.where(at < end[:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
        keys = self.walk(x, n)
        found = []
        for r, (k, items) in enumerate(self.tables[n]):
            a, b = np.searchsorted(k, keys[:, r], "left"), np.searchsorted(k, keys[:, r], "right")
            w = np.repeat(np.arange(len(start)), b - a)
            place = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            found.append(w * len(self.items) + items[place])
        e = edits(n, self.least)
        for c in np.unique(np.concatenate(found)).tolist():
            w, i = divmod(c, len(self.items))
            s, item = int(start[w]), self.items[i][1]
            a, b = max(int(lo[s]), s - e), min(int(hi[s]), s + n + e)
            region = h[a:b]
            if np.isin(item, region).sum() < n - e:
                continue
            d, x0, x1 = best_match(item, region)
            if d <= e:
                key = (i, a + x0, a + x1)
                out[key] = min(d, out.get(key, d))


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a part of ``region``, and that part's first and end place."""
    def ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        places = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64)
        for i, symbol in enumerate(x):
            nxt = np.empty_like(row)
            nxt[0] = i + 1
            nxt[1:] = np.minimum(row[:-1] + (y != symbol), row[1:] + 1)
            row = np.minimum.accumulate(nxt - places) + places
        return row

    last = ends(item, region)
    d = int(last.min())
    end = int(np.flatnonzero(last == d)[0])
    back = ends(item[::-1], region[:end][::-1])
    return d, end - int(np.flatnonzero(back == d)[0]), end


def walks_for(recall: float, apart: float, samples: int, keys: int) -> int:
    """Walks so that a pair whose embeddings differ in the share ``apart`` of steps meets with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** samples) / keys))


SPANS = "array<struct<item_id:bigint,start:int,end:int,distance:int>>"


def passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "passages", least: float = 0.8, least_words: int = 1, recall: float = 0.99, apart: float = 0.5, samples: int = 2, keys: int = 6) -> DataFrame:
    """``docs`` with the benchmark passages in each whole text: item, start and end (code points), word edits.

    A passage is a part of the text whose word edit distance to the item is at
    most 1 - ``least`` of the item's words, so an item of four words or fewer
    matches only as it is. Items with fewer than ``least_words`` words, null and
    empty ones too, match nothing. Null and empty texts
    have none. Overlapping parts that match an item as well are one passage, the
    best. The same rows come back, in any number; a column named ``out`` is
    replaced. Items are searched for in blocks, one after the other, so that one
    block at most is held in memory; from two blocks on the rows are written between them.
    """
    spark = docs.sparkSession
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, math.ceil(named.count() / ITEMS_AT_ONCE))
    walks = walks_for(recall, apart, samples, keys)
    col = F.coalesce(F.col(text), F.lit(""))
    tag, before = f"_{uuid.uuid4().hex}", None
    found = docs
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        hashed = [(r["i"], words_of(*joined_bytes(pa.array([r["t"]])))[0]) for r in rows]
        index = Index([x for x in hashed if x[0] is not None and len(x[1]) >= max(1, least_words)], least, samples, walks, keys)
        spans = _searched(spark, index)(col)
        if b:
            spans = F.concat(F.col(f"found{tag}"), spans)
        if blocks == 1:
            return docs.withColumn(out, spans)
        found = settle(found.withColumn(f"found{tag}", spans), "passages")
        if before is not None:
            discard(before)
        before = found
    return found.withColumn(out, F.col(f"found{tag}")).drop(f"found{tag}")


def _searched(spark, index: Index):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(SPANS)
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
        out: list[list] = [[] for _ in range(len(texts))]
        if shared.value.items:
            for i, j in slices(texts, SLICE):
                buf, off = joined_bytes(texts.slice(i, j - i))
                h, first, end, row = words_of(buf, off)
                best: dict[tuple[int, int], list[tuple]] = {}
                for item, a, b, d in shared.value.search(h, row):
                    best.setdefault((int(row[a]), item), []).append((d, a, b))
                for (r, item), found in best.items():
                    kept: list[tuple] = []
                    for d, a, b in sorted(found):
                        if all(b <= x or a >= y for _, x, y in kept):
                            kept.append((d, a, b))
                    own = buf[off[r] : off[r + 1]]
                    for d, a, b in kept:
                        s, e = (int(((own[: int(p) - off[r]] & 0xC0) != 0x80).sum()) for p in (first[a], end[b - 1]))
                        out[i + r].append((s, e, shared.value.items[item][0], d))
        return pa.array([[{"item_id": x, "start": s, "end": e, "distance": d} for s, e, x, d in sorted(o)] for o in out], kind)

    return of.asNondeterministic()


def without_passages(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage; columns stay as they are.

    Items under five words are left out here unless ``least_words`` says otherwise:
    every text may hold those by chance, and clean documents are to stay.
    """
    own = f"passages_{uuid.uuid4().hex}"
    return passages(docs, items, out=own, **{"least_words": 5} | options).where(F.size(own) == 0).drop(own)
