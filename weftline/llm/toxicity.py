"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Vectors hold all words of a text: (1 + ln n) for n occurrences, times the inverse
document frequency over all documents. Labels have no part in the similarity.

Labelled examples lie in an inverted index cut into blocks of similar ones. Terms
that many examples hold have full lists, whose sums are taken for all examples at
once: no similarity is below its sum, so the k-th best of them is one that the k
nearest reach. For each other term and block the index keeps the largest weight, so
a query's bound for a block is one sparse product on top of the block's largest sum.
The blocks whose bound reaches that similarity are scored exactly, once, which gives
the exact nearest examples.

In the vote a neighbour weighs by its distance and by what its similarity comes
from: each shared word adds its part of the cosine times its evidence, which is the
word's correlation with the label (phi) in the examples beyond what chance gives.
The vote is calibrated on labelled rows outside the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, joined_bytes, settle, slices
from .words import words_of

SLICE = 1 << 19
#: Examples in a block of the index.
BLOCK = 64
#: Terms in more than this share of the examples have full lists.
FREQUENT = 0.1
#: Places in which the documents with words outside the index are counted.
REST = 1 << 18
#: Weight in the vote of a neighbour that shares no word with evidence.
LEAST = 1e-4
#: Postings of the index that are read at once (those of one run at least).
ENTRIES = 1 << 17
#: Texts searched at once.
ROWS = 32
#: Multiplications in a product of full lists. Larger ones BLAS would share among threads, which then wait for work at a core's cost.
PRODUCT = (1 << 19) - 1


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different word of each text, by row, then hash."""
    rows, terms, n = [], [], []
    for i, j in slices(texts, SLICE):
        h, _, _, row = words_of(*joined_bytes(texts.slice(i, j - i)))
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        rows.append(row[at] + i)
        terms.append(h[at])
        n.append(np.diff(np.append(at, len(h))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(n)


def places(terms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each term in the sorted vocabulary; others have one of the ``REST`` places behind it, by their hash."""
    at = np.searchsorted(vocabulary, terms)
    own = at < len(vocabulary)
    own[own] = vocabulary[at[own]] == terms[own]
    return np.where(own, at, len(vocabulary) + (terms >> np.uint64(46)).astype(np.int64))


def _alike(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` of the rows, halved along the direction in which they differ most, down to blocks; the halves are whole blocks."""
    blocks = -(-len(order) // BLOCK)
    if blocks < 2 or not rows.shape[1]:
        return order
    x = rows[order]
    x = x - x.mean(0)
    along = x.sum(1)
    for _ in range(8):
        along = x @ (x.T @ along)
        along /= max(np.linalg.norm(along), 1e-300)
    order, half = order[np.argsort(along, kind="stable")], blocks // 2 * BLOCK
    return np.concatenate([_alike(rows, order[:half]), _alike(rows, order[half:])])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Index:
    """Unit vectors of the examples in an inverted index with block maxima.

    ``weight`` has the idf of each word of ``vocabulary`` and each of the places
    behind it, ``told`` the evidence of each word of ``vocabulary``.
    """

    vocabulary: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    k: int
    told: np.ndarray
    #: Words with evidence of each example, as numbers among all such words, and their weights times evidence.
    proof_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    proof: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    proof_value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: An entry is a term's part in one block; entries of a term and postings of an entry lie together.
    term_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    entry_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    member: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    blocks: int = 0
    #: Number of each term in ``full`` (-1: none), and the full lists by block, term and member.
    row_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    full: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, BLOCK)))
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    without: float = 0.0

    def unit(self, rows: np.ndarray, terms: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Place and weight of each word in its row's unit vector."""
        at = places(terms, self.vocabulary)
        w = (1 + np.log(n)) * self.weight[at]
        norm = np.sqrt(np.bincount(rows, w * w, minlength=size))
        return at, w / np.maximum(norm, 1e-300)[rows]

    def build(self, rows: np.ndarray, terms: np.ndarray, n: np.ndarray) -> None:
        """Indexes the examples, of which row i has ``ids[i]``; similar ones share a block."""
        size = len(self.ids)
        at, w = self.unit(rows, terms, n, size)
        by = np.lexsort((at, -w, rows))
        first = np.searchsorted(rows[by], np.arange(size))
        lead = [np.full(size, len(self.vocabulary)) for _ in range(3)]
        for q in range(3):
            there = np.flatnonzero(np.append(rows[by], -1)[np.minimum(first + q, len(by))] == np.arange(size))
            lead[q][there] = at[by[first[there] + q]]
        held = np.bincount(at, minlength=len(self.vocabulary))
        many = np.flatnonzero(held > max(BLOCK, FREQUENT * size))
        self.row_of = np.full(len(self.vocabulary), -1)
        self.row_of[many] = np.arange(len(many))
        self.blocks = -(-size // BLOCK)
        full = np.zeros((self.blocks * BLOCK, len(many)))
        often = np.flatnonzero(self.row_of[at] >= 0)
        full[rows[often], self.row_of[at[often]]] = w[often]
        back = _alike(full[:size], np.lexsort((self.ids, *lead[::-1])))
        place = np.empty(size, np.int64)
        place[back] = np.arange(size)
        full[:size] = full[back]
        self.full = np.ascontiguousarray(full.reshape(self.blocks, BLOCK, len(many)).transpose(0, 2, 1))
        del full
        own = np.flatnonzero(self.told[at] > 0)
        own = own[np.argsort(place[rows[own]], kind="stable")]
        self.proof, self.proof_value = self.numbers()[at[own]], w[own] * self.told[at[own]]
        self.proof_at = np.searchsorted(place[rows[own]], np.arange(size + 1))
        member = place[rows]
        order = np.lexsort((member, at))
        order = order[self.row_of[at[order]] < 0]
        at, member, w = at[order], member[order], w[order]
        block = member // BLOCK
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.ids, self.labels = self.ids[back], self.labels[back]
        self.member, self.value, self.block = member, w, block[start]
        self.most = np.maximum.reduceat(w, start) if len(start) else np.zeros(0)
        self.entry_at = np.append(start, len(at))
        self.term_at = np.searchsorted(at[start], np.arange(len(self.vocabulary) + 1))

    def nearest(self, rows: np.ndarray, at: np.ndarray, w: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row the k most similar examples (similarity above 0): similarities and places, best first, ties by smaller id."""
        if not self.blocks:
            return [(np.zeros(0), np.zeros(0, np.int64))] * size
        out: list[tuple[np.ndarray, np.ndarray]] = []
        known = at < len(self.vocabulary)
        rows, at, w = rows[known], at[known], w[known]
        cut = np.searchsorted(rows, np.arange(size + 1))
        width = self.blocks * BLOCK
        k = min(self.k, width)
        for i in range(0, size, ROWS):
            j = min(i + ROWS, size)
            sums = self._frequent(rows[cut[i] : cut[j]] - i, at[cut[i] : cut[j]], w[cut[i] : cut[j]], j - i)
            least = np.partition(sums, width - k, axis=1)[:, width - k]
            out += [self._nearest(at[a:b], w[a:b], x, low) for a, b, x, low in zip(cut[i:j], cut[i + 1 : j + 1], sums, least, strict=True)]
        return out

    def _frequent(self, rows: np.ndarray, at: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """For each row the sums of frequent terms of all examples."""
        terms = self.full.shape[1]
        query, number = np.zeros((size, terms)), self.row_of[at]
        own = number >= 0
        query[rows[own], number[own]] = w[own]
        sums = np.empty((size, self.blocks, BLOCK))
        step = max(1, PRODUCT // (BLOCK * max(1, terms)))
        for i in range(0, size, step):
            np.matmul(query[i : i + step], self.full, out=sums[i : i + step].transpose(1, 0, 2))
        return sums.reshape(size, self.blocks * BLOCK)

    def _nearest(self, at: np.ndarray, w: np.ndarray, sims: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of one text; ``sims`` has the sums of its frequent terms, ``least`` the k-th best of them."""
        blocks = sims.reshape(self.blocks, BLOCK)
        reads = self.term_at[at + 1] - self.term_at[at]
        entry, part = _spans(self.term_at[at], reads), np.repeat(w, reads)
        block = self.block.take(entry)
        bound = np.bincount(block, part * self.most.take(entry), minlength=self.blocks) + blocks.max(1)
        chosen = (bound > 0) & (bound >= least - 1e-9)
        own = chosen.take(block)
        entry, part = entry[own], part[own]
        # chosen blocks that follow one another in a list are read as one run
        new = np.ones(len(entry) + 1, bool)
        new[1:-1] = (entry[1:] != entry[:-1] + 1) | (part[1:] != part[:-1])
        run = np.flatnonzero(new)
        part, start = part[run[:-1]], self.entry_at[entry[run[:-1]]]
        n = self.entry_at[entry[run[1:] - 1] + 1] - start
        ends, i = np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + ENTRIES, "right")))
            p = _spans(start[i:j], n[i:j])
            np.add.at(sims, self.member.take(p), np.repeat(part[i:j], n[i:j]) * self.value.take(p))
            i = j
        blocks[~chosen] = 0
        # sums differ in the last digits with the order of their terms, so similarities are compared at 12 digits
        near = np.flatnonzero(sims >= max(least - 1e-11, 1e-300))
        exact = sims[near]
        if len(near) > self.k:
            best = exact >= np.partition(exact, len(near) - self.k)[len(near) - self.k] - 1e-11
            near, exact = near[best], exact[best]
        exact = np.round(exact, 12)
        best = np.lexsort((self.ids[near], -exact))[: self.k]
        return exact[best], near[best]

    def numbers(self) -> np.ndarray:
        """The number of each word of the vocabulary among those with evidence; -1 for others."""
        own = self.told > 0
        return np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)

    def proofs(self, rows: np.ndarray, at: np.ndarray, w: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each row and neighbour the part of the cosine that comes from words with evidence, times it."""
        number = np.append(self.numbers(), -1)[np.minimum(at, len(self.told))]
        own = number >= 0
        rows, number, w = rows[own], number[own], w[own]
        cut = np.searchsorted(rows, np.arange(len(near) + 1))
        query, out = np.zeros(int((self.told > 0).sum())), []
        for r, (_, members) in enumerate(near):
            held = number[cut[r] : cut[r + 1]]
            query[held] = w[cut[r] : cut[r + 1]]
            size = self.proof_at[members + 1] - self.proof_at[members]
            p = _spans(self.proof_at[members], size)
            out.append(np.bincount(np.repeat(np.arange(len(members)), size), query[self.proof[p]] * self.proof_value[p], minlength=len(members)))
            query[held] = 0
        return out

    def vote(self, sims: np.ndarray, near: np.ndarray, proof: np.ndarray) -> float:
        """Share of the label among the neighbours, weighted by (evidence shared + ``LEAST``) / (distance + 0.05)."""
        w = (proof + LEAST) / (1.05 - sims)
        return float(w @ self.labels[near] / w.sum())

    def neighbours(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Similarities, places and shared evidence of the nearest examples of each text."""
        return self.searched(*term_counts(texts), len(texts))

    def searched(self, rows: np.ndarray, terms: np.ndarray, n: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at, w = self.unit(rows, terms, n, size)
        near = self.nearest(rows, at, w, size)
        return [(*x, proof) for x, proof in zip(near, self.proofs(rows, at, w, near), strict=True)]

    def score(self, texts: pa.Array) -> pa.StructArray:
        """Score and neighbours of each text; equal texts are looked up once."""
        coded = texts.dictionary_encode()
        values, sizes, ids, sims = [], [], [], []
        for near_sims, near, proof in (x for i, j in slices(coded.dictionary) for x in self.neighbours(coded.dictionary.slice(i, j - i))):
            values.append(float(np.interp(self.vote(near_sims, near, proof), *self.curve)) if len(near) else self.without)
            sizes.append(len(near))
            ids.append(self.ids[near])
            sims.append(near_sims)
        near = pa.StructArray.from_arrays([pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*sims, np.zeros(0)]))], ["doc_id", "similarity"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), near)
        return pa.StructArray.from_arrays([pa.array(values, pa.float64()), lists], ["score", "neighbours"]).take(coded.indices)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through pooled means (pool adjacent violators), with one case of either label as a prior."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, number
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    xs, ys = np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * (p[1] > 0)) / (p[2] + 1) for p in pools])
    return xs, np.maximum.accumulate(ys)


def evidence(n: np.ndarray, positive: np.ndarray, size: int, label: int) -> np.ndarray:
    """Weight of words that stand in ``n`` of ``size`` examples, ``positive`` of them among the ``label`` ones with label 1.

    The correlation with the label beyond three times what chance gives; zero for most words.
    """
    a, b = positive.astype(float), (n - positive).astype(float)
    c, d = label - a, size - label - b
    phi = np.abs(a * d - b * c) / np.sqrt(np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9))
    noise = max(size, 1) ** -0.5
    return np.maximum(0, phi - 3 * noise)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = 8000, k: int = 50) -> Index:
    """Learns from labelled rows outside the held-out fold (crc32 of the id mod 4 = 2).

    About ``examples`` labelled rows at most are read, picked by a hash of their
    id; two thirds make the index, one third calibrates. The words of the index
    are those of its examples, all of them. Document frequencies are counted over
    all rows of ``docs``, exactly for these words; others, which count in the
    length of a text outside the index alone, share ``REST`` places, so which
    examples are nearest, and in which order, is exact.
    """
    known = labels.where((fold(doc_id) != 2) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(u < min(1.0, examples / max(1, total)))
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    part = F.pmod(F.xxhash64(F.col("id").cast("bigint"), F.lit("calibrate")), F.lit(3))
    sample = settle(plain.join(known, "id").select(F.col("id").cast("bigint").alias("id"), "y", part.alias("part"), "t"), "examples")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, n = term_counts(batch.column(3))
            cut = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (terms.view(np.int64), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["id", "y", "part", "h", "n"])

    got = sample.mapInArrow(counted, "id bigint, y int, part bigint, h array<bigint>, n array<bigint>").toArrow().combine_chunks()
    # repeated rows of an id are told apart by their words, so that row order decides nothing
    ids, y, part = (got[c].to_numpy() for c in ("id", "y", "part"))
    keys = [(int(i), h.tobytes(), n.tobytes()) for i, h, n in zip(ids, _lists(got["h"]), _lists(got["n"]), strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    index_rows, rest_rows = [i for i in order if part[i] != 0], [i for i in order if part[i] == 0]

    def flat(chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hs, ns = ([np.frombuffer(keys[i][q], np.int64) for i in chosen] for q in (1, 2))
        empty = [np.zeros(0, np.int64)]
        return np.repeat(np.arange(len(chosen)), [len(h) for h in hs]), np.concatenate(hs or empty).view(np.uint64), np.concatenate(ns or empty)

    truth = y[rest_rows].astype(float) if rest_rows else np.zeros(0)
    rest = flat(rest_rows)
    rows, terms, n = flat(index_rows)
    del got, keys
    vocabulary, which = np.unique(terms, return_inverse=True)
    own = y[index_rows].astype(float) if index_rows else np.zeros(0)
    places_of = len(vocabulary) + REST

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, size = np.zeros(places_of + 1, np.int64), 0
        for batch in batches:
            size += len(batch)
            for i, j in slices(batch.column(0), SLICE):
                np.add.at(df, places(term_counts(batch.column(0).slice(i, j - i))[1], vocabulary), 1)
        df[-1] = size
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there])], ["at", "n"])

    counts = plain.select("t").mapInArrow(frequencies, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(places_of + 1)
    df[counts["at"].to_numpy()] = counts["n"].to_numpy()
    weight = np.log((df[-1] + 1) / (np.minimum(df[:-1], df[-1]) + 1)) + 1
    held = np.bincount(which, minlength=len(vocabulary)), np.bincount(which, own[rows] if len(rows) else None, minlength=len(vocabulary))
    told = evidence(held[0], held[1], len(own), int(own.sum()))
    index = Index(vocabulary, weight, ids[index_rows].astype(np.int64) if index_rows else np.zeros(0, np.int64), own, k, told)
    if index_rows:
        index.build(rows, terms, n)
    del rows, terms, n, which
    near = index.searched(*rest, len(rest_rows))
    some = np.array([len(x[1]) > 0 for x in near], bool)
    index.curve = _isotonic(np.array([index.vote(*x) for x in near if len(x[1])]), truth[some])
    none = truth[~some]
    index.without = float((none.sum() + 0.5) / (len(none) + 5)) if own.sum() else 0.0
    if not own.sum():
        index.curve = (np.zeros(1), np.zeros(1))
    discard(sample)
    return index


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        cut, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        out += [values[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


KIND = "score double, neighbours array<struct<doc_id:bigint,similarity:double>>"


def scored(text: str | Column, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(KIND)
    def of(texts: pa.Array) -> pa.Array:
        return shared.value.score(texts)

    return of.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", out: str = "toxicity", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: ``score`` (0 to 1) and the nearest labelled examples as evidence.

    Scores use the whole text alone. A text without any word of the examples
    (null and empty ones, too) gets the share of the label among such examples.
    If nothing can be learned, every score is 0. Rows stay as they are, repeated
    ones too; a column named ``out`` is replaced. A document with several
    labels counts as labelled 1 if any is. Of equally similar examples those with
    smaller ids come first.
    """
    return docs.withColumn(out, scored(text, fit(docs, labels, doc_id, text, label, **options), docs.sparkSession))
