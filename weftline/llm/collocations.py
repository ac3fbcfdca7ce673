"""Collocations: phrases whose words stand together far more often than their parts explain, per language.

All 1- to ``max_n``-grams are exploded and counted by a hash (a pass over the
texts for each few lengths, so that one pass's shuffle is on disk at a time);
those that can reach ``least`` are exploded again as text, through a bit filter
of bounded size, and counted exactly. Prefix and suffix counts are joined, scores
are whole numbers in Decimal, phrases that a one-word extension explains go by an
anti-join, and a window ranks each language.

Defined results: a null text has no words, a null language is ``und``; repeated
rows count again; ties are ordered by count, then by the phrase's bytes; an
empty table gives no rows; other columns are not read. Long texts are cut nowhere.
A phrase whose 64-bit hash is that of a commoner one within a megabyte of text
would be counted as that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, joined_bytes, settle, slices
from .words import M, mix, words_of

#: Bytes of text that a task looks at together.
SLICE = 1 << 20
#: Bits of the filter of frequent hashes at most (16 MB); a fuller filter lets more through to the exact count.
FILTER_BITS = 1 << 27
#: Phrases that are made as text together.
PHRASES = 1 << 14
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes end a piece, and which belong to words."""
    ends = np.zeros(256, bool)
    ends[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    word = ~ends
    word[[0x20, 0x09]] = False
    return ends, word


class Words:
    """The words of some rows: hash, first and end byte, row and piece; and hashes of the n-grams from each word on."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        ends, word = _tables()
        self.buf, off = joined_bytes(texts)
        self.hash, self.first, self.end, self.row = words_of(self.buf, off, word)
        before = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(ends[self.buf], out=before[1:])
        self.piece = before[self.first] + self.row
        self.names, codes = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.lang = codes[self.row]
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
        self.grams = mix(self.hash ^ seeds[self.lang]) if len(self.row) else self.hash
        self.n = 1

    def longer(self) -> None:
        """Goes on to n-grams of one more word; those that would leave their piece end."""
        self.n += 1
        k = max(0, len(self.hash) - self.n + 1)
        self.grams = mix(self.grams[:k] * np.uint64(M) + self.hash[self.n - 1 :]) if k else self.grams[:0]

    def whole(self) -> np.ndarray:
        """Where an n-gram lies within one piece."""
        return self.piece[: len(self.grams)] == self.piece[self.n - 1 :] if len(self.grams) else np.zeros(0, bool)

    def spaced(self) -> None:
        """Lays the lower-cased words out with one space between them, so that an n-gram's text is a range of bytes."""
        size = self.end - self.first
        to = np.cumsum(size + 1) - size - 1
        self.line = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.line[np.repeat(to, size) + within] = FOLD[self.buf[np.repeat(self.first, size) + within]]
        self.line_first, self.line_end = to, to + size

    def texts(self, at: np.ndarray) -> pa.Array:
        """The texts of the n-grams that start at some words."""
        first = self.line_first[at]
        size = self.line_end[at + self.n - 1] - first
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        data = self.line[np.arange(off[-1]) + np.repeat(first - off[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(data)).cast(pa.string())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        for i, j in slices(texts, SLICE):
            yield Words(texts.slice(i, j - i), langs[i:j])


def _count_by_hash(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``h`` and ``c`` of all n-grams of some lengths; with single words also ``lang`` and the words of each language, without hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(batches):
            while w.n <= max(lengths):
                if w.n in lengths:
                    h, c = np.unique(w.grams[w.whole()], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "h", "c"])
                if w.n == 1 in lengths:
                    n = np.bincount(w.lang, minlength=len(w.names))
                    yield pa.RecordBatch.from_arrays([pa.array(w.names.tolist(), pa.string()), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64))], ["lang", "h", "c"])
                w.longer()

    return docs.mapInArrow(count, "lang string, h bigint, c bigint")


def _bit_filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes, 16 a hash up to ``FILTER_BITS``; the only thing that is gathered, and of bounded size."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << int(16 * max(1, frequent.count()) - 1).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = frequent.groupBy(F.shiftright(at, 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words.i.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def phrase_counts(docs: DataFrame, max_n: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``max_n`` words with f >= ``least`` (``lang``, ``phrase``, ``k`` words, ``f``), and ``n`` words of each language; both settled."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    passes = [(1, 2)[:max_n], *[(k,) for k in range(3, max_n + 1)]]
    counted = [settle(_count_by_hash(texts, p).groupBy("lang", "h").agg(F.sum("c").alias("c")).where(F.col("h").isNull() | (F.col("c") >= least)), "grams") for p in passes]
    frequent = counted[0].where("h is not null")
    for more in counted[1:]:
        frequent = frequent.unionByName(more)
    words = settle(counted[0].where("h is null").select("lang", F.col("c").alias("n")), "language-words")
    held = spark.sparkContext.broadcast(_bit_filter(frequent))
    discard(*counted)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        mask = np.uint64(len(bits) * 64 - 1)
        for w in _batches(batches):
            w.spaced()
            names = pa.array(w.names.tolist(), pa.string())
            while w.n <= max_n:
                own = np.flatnonzero(w.whole())
                at = w.grams[own] & mask
                own = own[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                _, one, c = np.unique(w.grams[own], return_index=True, return_counts=True)
                one = own[one]
                for i in range(0, len(one), PHRASES):
                    some = one[i : i + PHRASES]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(w.lang[some])), w.texts(some), pa.array(np.full(len(some), w.n, np.int32)), pa.array(c[i : i + PHRASES].astype(np.int64))], ["lang", "phrase", "k", "c"])
                w.longer()

    exact = texts.mapInArrow(phrases, "lang string, phrase string, k int, c bigint").groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.sum("c").alias("f")).where(F.col("f") >= least)
    out = settle(exact, "phrases")
    held.unpersist()
    return out, words


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of 2 to ``max_n`` words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a``, ``l`` and ``r`` count the phrase, its first part and its rest at the
    lowest-scoring cut; ``docs`` has ``text`` and ``lang``.
    """
    f, words = phrase_counts(docs, max_n, least)
    phrases = f.where("k >= 2").withColumnRenamed("f", "a")
    cut = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).withColumn("w", F.split("phrase", " ", -1))
    parts = cut.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("p1"), F.array_join(F.expr("slice(w, cut + 1, k - cut)"), " ").alias("p2"))
    left = f.select("lang", F.col("phrase").alias("p1"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("p2"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").alias("score")
    scored = parts.join(left, ["lang", "p1"]).join(right, ["lang", "p2"]).select("lang", "phrase", "a", F.struct(score, "cut", "l", "r").alias("c"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # of the phrases around a phrase the shortest are the most frequent, so extensions by one word stand for all
    w = F.split("phrase", " ", -1)
    inner = phrases.where("k >= 3").select("lang", F.explode(F.array_distinct(F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " ")))).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer")).join(phrases.select("lang", "phrase", "a"), ["lang", "phrase"])
    explained = around.where(F.expr("cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * 80")).select("lang", "phrase")
    kept = lowest.join(explained, ["lang", "phrase"], "left_anti")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(words) if words.count() <= 10_000 else words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
