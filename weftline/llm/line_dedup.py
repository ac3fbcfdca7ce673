"""Line dedup over an index that takes documents in and out again.

The index is a set of tables in the shared folder: ``lines`` (which document holds
which key), exact ``refs`` (documents a key, the smallest one), and cuckoo
filters, a row a shard, of the keys in use and of those that two documents share.
Filters take insertions and deletions, so they follow the exact tables both ways:
a key whose filter says no is new and skips the lookup in ``refs``, and a
document's line whose filter says no is shared with nobody and isn't shuffled.
Whatever a filter lets through is decided by the exact tables.

A key is a line without blanks at its ends, A-Z lower-cased, of ``LEAST`` code points or
more; keys are held as 128 bits. Shards are dealt by hash, so a key that a third
of all lines hold is one entry. Defined results: a null text is an empty one; rows
with one doc_id are one document; rows without doc_id keep all their lines and
count nowhere; repeated lines of one document alone stay. Other columns pass
through ``dedup`` (its own are named ``n_lines``, ``n_dropped``, ``kept``); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from .common import discard, settle, spread_join

LEAST = 10
BLANKS = " \t\n\x0b\x0c\r"
#: Keys a shard's filter is made for; a fuller shard gets further filters.
PER_SHARD = 100_000
#: Slots a bucket, and rounds of moving entries before a filter counts as full.
SLOTS, ROUNDS = 4, 200
#: Bytes of filters that go to all tasks; beyond it all lines are shuffled to their keys.
FILTER_BYTES = 64 << 20
KEY = ["k1", "k2"]


# --- cuckoo filters -------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Cuckoo:
    """A filter of 16-bit fingerprints in buckets of four; numpy takes many keys at a time."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table  # buckets x slots, 0 is free

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(keys / (SLOTS * 0.9)) - 1).bit_length())
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (_mixed(k2.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (_mixed(k1.view(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (_mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(k1, k2)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _put(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets, one a bucket and call; returns which found one."""
        done = np.zeros(len(at), bool)
        _, first = np.unique(at, return_index=True)
        free = self.table[at[first]] == 0
        fits = free.any(1)
        own = first[fits]
        self.table[at[own], free[fits].argmax(1)] = mark[own]
        done[own] = True
        return done

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Inserts distinct keys that it doesn't hold; returns which found no place (the filter is as it was for them)."""
        mark, one, two = self.places(k1, k2)
        left = np.arange(len(mark))
        for at in (one, two) * SLOTS:
            left = left[~self._put(at[left], mark[left])]
        rng, failed = np.random.default_rng(len(self.table)), np.zeros(len(mark), bool)
        for i in left:  # few: each pushes others along until one finds a free slot, or all moves are undone
            m, at, moves = mark[i], (one if rng.random() < 0.5 else two)[i], []
            for _ in range(ROUNDS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
                slot = int(rng.integers(SLOTS))
                moves.append((at, slot, self.table[at, slot]))
                self.table[at, slot], m = m, self.table[at, slot]
                at = int(self.other(np.array([at]), np.array([m], np.uint16))[0])
            else:
                failed[i] = True
                for at, slot, m in reversed(moves):
                    self.table[at, slot] = m
        return failed

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Takes one entry away for each of the distinct keys; returns which had none."""
        mark, one, two = self.places(k1, k2)
        left = np.arange(len(mark))
        for _ in range(2 * SLOTS):  # keys of one bucket take turns
            for at in (one, two):
                if len(left):
                    _, first = np.unique(at[left], return_index=True)
                    own = left[first]
                    hit = self.table[at[own]] == mark[own, None]
                    some = hit.any(1)
                    self.table[at[own[some]], hit[some].argmax(1)] = 0
                    left = np.setdiff1d(left, own[some])
        missing = np.zeros(len(mark), bool)
        missing[left] = True
        return missing


def _loaded(blobs) -> list[Cuckoo]:
    return [Cuckoo(np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy()) for b in blobs]


def _changed(filters: list[Cuckoo], k1: np.ndarray, k2: np.ndarray, gone: np.ndarray) -> list[Cuckoo]:
    """Filters of a shard after keys went and came; what finds no place gets a further filter."""
    out1, out2 = k1[gone], k2[gone]
    for f in filters:
        if len(out1):
            missing = f.delete(out1, out2)
            out1, out2 = out1[missing], out2[missing]
    in1, in2 = k1[~gone], k2[~gone]
    for f in filters:
        if len(in1):
            failed = f.insert(in1, in2)
            in1, in2 = in1[failed], in2[failed]
    while len(in1):
        f = Cuckoo.of_size(max(2 * len(in1), PER_SHARD // 8) if filters else len(in1) * 5 // 4 + 16)
        failed = f.insert(in1, in2)
        in1, in2 = in1[failed], in2[failed]
        filters.append(f)
    return filters


FILTERS = "shard int, tables array<binary>"


def change_filters(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """Filters after the distinct ``keys`` (``shard``, ``k1``, ``k2``, ``gone``) came or went; a shard is in one task, its size is bounded."""

    def change(key: tuple, old: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = _changed(_loaded(old.tables.iloc[0] if len(old) else ()), own.k1.to_numpy(np.int64), own.k2.to_numpy(np.int64), own.gone.to_numpy(bool))
        return pd.DataFrame({"shard": [key[0]], "tables": [[f.table.tobytes() for f in found]]})

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, FILTERS)


def probed(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with ``maybe``: whether their shard's filter may hold them."""

    def probe(key: tuple, old: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(own), bool)
        for f in _loaded(old.tables.iloc[0] if len(old) else ()):
            hit |= f.has(own.k1.to_numpy(np.int64), own.k2.to_numpy(np.int64))
        return own.assign(maybe=hit)

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(probe, keys.withColumn("maybe", F.lit(True)).schema)


# --- the index ------------------------------------------------------------


def lines_of(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def keys_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the 128-bit key of each line that is long enough, each key once a row."""

    def key(line: Column) -> Column:
        return F.translate(F.btrim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    found = F.array_distinct(F.filter(F.transform(lines_of("text"), key), lambda k: F.char_length(k) >= LEAST))
    own = docs.select(*keep, F.explode(found).alias("__key"))
    return own.select(*keep, F.xxhash64("__key").alias("k1"), F.xxhash64(F.lit("second"), "__key").alias("k2"))


@dataclass
class LineIndex:
    """Lines of the documents taken in so far; ``insert`` and ``delete`` give a new index and leave this one as it is."""

    spark: SparkSession
    shards: int
    lines: DataFrame  # doc_id, k1, k2
    refs: DataFrame  # shard, k1, k2, refs, first
    in_use: DataFrame  # filters of all keys
    shared: DataFrame  # filters of keys of two or more documents

    @classmethod
    def empty(cls, spark: SparkSession, keys: int, doc_id: str = "bigint") -> LineIndex:
        """An index for about so many keys; more only make its filters longer."""
        nothing = [spark.createDataFrame([], s) for s in (f"doc_id {doc_id}, k1 bigint, k2 bigint", f"shard int, k1 bigint, k2 bigint, refs bigint, first {doc_id}", FILTERS, FILTERS)]
        return cls(spark, max(1, -(-keys // PER_SHARD)), *nothing)

    def shard(self) -> Column:
        return F.pmod(F.hash("k1", "k2"), F.lit(self.shards)).alias("shard")

    def tables(self) -> list[DataFrame]:
        return [self.lines, self.refs, self.in_use, self.shared]

    def _next(self, lines: DataFrame, refs: DataFrame, before: DataFrame) -> LineIndex:
        """The index with new exact tables; ``before`` are the refs (``was``) of the keys that changed, with ``refs`` now."""
        moved = settle(before, "changed-keys")
        own = [
            change_filters(old, moved.where((F.col("was") >= least) != (F.col("refs") >= least)).select("shard", *KEY, (F.col("refs") < least).alias("gone")))
            for old, least in ((self.in_use, 1), (self.shared, 2))
        ]
        out = LineIndex(self.spark, self.shards, lines, refs, settle(own[0], "in-use"), settle(own[1], "shared"))
        discard(moved)
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """Takes documents in (``doc_id``, ``text``) that aren't in the index yet."""
        added = settle(keys_of(docs.where("doc_id is not null"), "doc_id").distinct() if self._repeats(docs) else keys_of(docs.where("doc_id is not null"), "doc_id"), "lines")
        new = settle(added.groupBy(*KEY).agg(F.count("*").alias("more"), F.min("doc_id").alias("least")).select(self.shard(), *KEY, "more", "least"), "new-refs")
        if self.lines.isEmpty():
            now = settle(new.select("shard", *KEY, F.col("more").alias("refs"), F.col("least").alias("first")), "refs")
            out = self._next(added, now, now.select("shard", *KEY, F.lit(0).cast("bigint").alias("was"), "refs"))
            discard(new)
            return out
        asked = settle(probed(self.in_use, new), "probed")
        maybe = asked.where("maybe").drop("maybe", "shard")
        known = self.refs.join(maybe, KEY).select("shard", *KEY, (F.col("refs") + F.col("more")).alias("refs"), F.least("first", "least").alias("first"), F.col("refs").alias("was"))
        fresh = asked.where("not maybe").unionByName(asked.where("maybe").join(self.refs.select(*KEY), KEY, "left_anti"))
        touched = settle(known.unionByName(fresh.select("shard", *KEY, F.col("more").alias("refs"), F.col("least").alias("first"), F.lit(0).cast("bigint").alias("was"))), "touched")
        refs = settle(self.refs.join(maybe.select(*KEY), KEY, "left_anti").select(*self.refs.columns).unionByName(touched.drop("was")), "refs")
        out = self._next(settle(self.lines.unionByName(added), "lines"), refs, touched.select("shard", *KEY, "was", "refs"))
        discard(new, asked, touched, added)
        return out

    @staticmethod
    def _repeats(docs: DataFrame) -> bool:
        """Whether a doc_id stands in more than one row."""
        return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()

    def delete(self, ids: DataFrame) -> LineIndex:
        """Takes documents out (``doc_id``); what they alone held is forgotten, and what they held first passes on."""
        ids = ids.select("doc_id").where("doc_id is not null").distinct()
        gone = settle(self.lines.join(ids, "doc_id", "left_semi").groupBy(*KEY).agg(F.count("*").alias("less")), "gone")
        lines = settle(self.lines.join(ids, "doc_id", "left_anti").select(*self.lines.columns), "lines")
        first = lines.join(gone.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("doc_id").alias("least"))
        touched = settle(self.refs.join(gone, KEY).join(first, KEY, "left").select("shard", *KEY, (F.col("refs") - F.col("less")).alias("refs"), F.col("least").alias("first"), F.col("refs").alias("was")), "touched")
        refs = settle(self.refs.join(gone.select(*KEY), KEY, "left_anti").select(*self.refs.columns).unionByName(touched.where("refs > 0").drop("was")), "refs")
        out = self._next(lines, refs, touched.select("shard", *KEY, "was", "refs"))
        discard(gone, touched)
        return out

    def dropped(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``k1``, ``k2`` of the lines that documents of the index lose, each once a document."""
        shared = self.refs.where("refs >= 2").select(*KEY, "first", F.col("refs").alias("rows_of_key"))
        own = settle(self._maybe_shared(keys_of(docs.where("doc_id is not null"), "doc_id")), "maybe-shared")
        total = self.refs.agg(F.sum("refs")).first()[0] or 0
        at = F.struct(*KEY).alias("key")
        found = spread_join(own.withColumn("key", at), shared.withColumn("key", at).drop(*KEY), "key", total)
        return found.where("doc_id <> first").select("doc_id", *KEY)

    def _maybe_shared(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters of shared ones let through; all, if these filters are too large to send around."""
        sized = self.shared.select("shard", F.expr("aggregate(transform(tables, x -> octet_length(x)), 0L, (a, x) -> a + x)").alias("size"))
        if (sized.agg(F.sum("size")).first()[0] or 0) > FILTER_BYTES:
            return keys
        held = self.spark.sparkContext.broadcast({r.shard: [bytes(t) for t in r.tables] for r in self.shared.collect()})
        columns = keys.columns

        def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters = {s: _loaded(tables) for s, tables in held.value.items()}
            for part in parts:
                k1, k2, shard = part.k1.to_numpy(np.int64), part.k2.to_numpy(np.int64), part["shard"].to_numpy()
                order = np.argsort(shard, kind="stable")
                hit = np.zeros(len(part), bool)
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(part) else []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    own = order[i:j]
                    for f in filters.get(int(shard[own[0]]), ()):
                        hit[own] |= f.has(k1[own], k2[own])
                yield part.loc[hit, columns]

        return keys.withColumn("shard", self.shard()).mapInPandas(probe, keys.schema)

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``: the text without the lines that an earlier document holds.

        The keys that a document loses meet its row by ``doc_id``; both sides of that join
        are as large as a document at most.
        """
        lost = self.dropped(docs).groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("__lost"))
        own = docs.join(lost, "doc_id", "left")
        number = F.transform(lines_of("text"), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        # the keys of a document that loses lines are hashed again and looked up beside its text
        own = own.withColumn("__keys", F.when(F.col("__lost").isNotNull(), F.transform(number, lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit("second"), k).alias("k2")))))
        own = own.withColumn("__drop", _listed(F.col("__keys.k1"), F.col("__keys.k2"), F.col("__lost.k1"), F.col("__lost.k2")))
        kept = F.when(F.col("__lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(F.arrays_zip(lines_of("text").alias("line"), F.col("__drop").alias("drop")), lambda x: ~x["drop"])["line"], "\n"))
        n = F.size(F.filter("__drop", lambda x: x))
        return own.select(*docs.columns, F.size(lines_of("text")).cast("bigint").alias("n_lines"), F.when(F.col("__lost").isNull(), 0).otherwise(n).cast("bigint").alias("n_dropped"), kept.alias("kept"))


@F.pandas_udf(ArrayType(BooleanType()))
def _listed(k1: pd.Series, k2: pd.Series, l1: pd.Series, l2: pd.Series) -> pd.Series:
    """Which of a row's keys are in its list."""
    return pd.Series([None if a is None else [x in own for x in zip(a, b, strict=True)] for a, b, c, d in zip(k1, k2, l1, l2, strict=True) for own in [set(zip(c, d, strict=True)) if c is not None else ()]], dtype=object)


def index_of(docs: DataFrame) -> LineIndex:
    """An index of all documents."""
    keys = docs.select(F.sum(F.size(lines_of("text")))).first()[0] or 0
    return LineIndex.empty(docs.sparkSession, keys, dict(docs.dtypes)["doc_id"]).insert(docs)
