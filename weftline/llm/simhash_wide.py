"""SimHash near-duplicates by similarity: distinct shingles of five words, Jaccard 0.8 or more.

Texts as similar as that differ in about 15 % of their fingerprint bits, too many
for a lossless pigeonhole. Fingerprints are 256 bits here, and the pigeonhole is
the generalised one with soft bits: correlated bits are grouped into partitions,
a dynamic programme gives each its number of flips from estimated candidate
counts, and a text enters a partition under all variants of its bits in those
with the closest votes. Such bits are the ones that differ between near copies.
Texts that meet under a variant and are within ``TAU`` bits are candidates; their
shingle sets decide.

A bucket of fingerprints never makes all its pairs. Up to ``SMALL`` members are
compared directly; more of them give the nearest-neighbour tree of each ``BLOCK``
in order of the fingerprints, and neighbouring blocks share their first member.
Buckets of different partitions cut the same texts differently, so that a group
is joined by many trees.

Fingerprints join large groups at little cost, but lose links. A prefix filter
finds the rest without loss: in one order of all shingles, rare ones first, two
texts of a similarity of 0.8 share one of the first n - ceil(0.8 n) + 1. Texts
that meet there, lie in different groups and can still have enough shingles in
common are compared, all of them.

Pairs are compared by marks first, a few bits a shingle, which rule out most of
those below 0.8 and none above; only the others need whole sets. Both take as
many pairs at a time as bounds what is written by the size of the corpus; only
the list of the pairs' ids grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_bytes, settle, slices, spread_join
from .components import components
from .simhash import _grouped, allocate
from .words import M, mix, words_of

BITS, BANDS, FLIPS, TAU = 256, 12, 2, 52
SMALL, BLOCK = 8, 512
#: Rows of a shingle that are joined in one task; more are dealt to several.
TOGETHER = 2000
#: First shingles of a prefix that go with each of its rows, so that a pair meets once in most cases.
HEAD = 3
#: Shingles of the pairs that are compared at a time, by marks (3 bits a shingle) and by sets (64): so many times those of all texts, ``LEAST`` at least.
BY_MARKS, BY_SETS, LEAST = 8, 0.25, 1 << 22
#: Odd factors that spread one shingle hash to four words of 64 bits.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _word_bytes() -> np.ndarray:
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def shingles_of(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, ordered by both. Texts with fewer than k words have one, without words none."""
    buf, off = joined_bytes(texts)
    h, _, _, row = words_of(buf, off, _word_bytes())
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    size = np.minimum(n, k)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    rows = np.repeat(np.arange(len(texts)), count)
    start = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    out = size[rows].astype(np.uint64)
    for j in range(k):
        here = j < size[rows]
        out[here] = mix((out[here] + h[start[here] + j]) * np.uint64(M))
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[new], out[new]


def votes_of(hashes: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """For each of the 256 bits, shingles with it minus shingles without it."""
    votes = np.full(BITS, -len(hashes), np.int64)
    for i in range(0, len(hashes), at_once):
        part = hashes[i : i + at_once]
        words = np.stack([mix(part * np.uint64(s)) for s in SPREAD], axis=1)
        votes += 2 * np.unpackbits(words.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return votes


def marks_of(hashes: np.ndarray) -> bytes:
    """A bit for each shingle by the low bits of its hash, 2 to 4 bits a shingle and 64 at least; of a power of two, so that halves fold."""
    bits = np.zeros(max(64, 1 << max(0, 2 * len(hashes) - 1).bit_length()), bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _prints(texts: pa.Array) -> tuple[list[int], list[bytes], list[bytes], list[bytes]]:
    sizes, fps, margins, marks = [], [], [], []
    for i, j in slices(texts):
        rows, hashes = shingles_of(texts.slice(i, j - i))
        cut = np.searchsorted(rows, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            votes = votes_of(hashes[a:b])
            sizes.append(int(b - a))
            fps.append(np.packbits(votes > 0).tobytes())
            margins.append(np.minimum(np.abs(votes) * (64 / max(1.0, float(b - a) ** 0.5)), 255).astype(np.uint8).tobytes())
            marks.append(marks_of(hashes[a:b]))
    return sizes, fps, margins, marks


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, *rest = _prints(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], ["doc_id", "th", "n", "fp", "margin", "marks"])


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = np.unpackbits(_matrix(batch.column(0), BITS // 8), axis=1).astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])


def plan_for(fps: DataFrame, bands: int = BANDS, flips: int = FLIPS, most: int = 4) -> tuple[list[list[int]], tuple[int, ...]]:
    """The bits of each partition and its flips, ``flips`` on average and ``most`` at most.

    Bit counts and correlations come from all fingerprints in ``fp``; the driver
    gets 256 x 256 sums.
    """
    n = max(fps.count(), 1)
    joint = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(_moments, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        joint[r["i"], r["j"]] = r["n"] / n
    p = np.diag(joint).copy()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))
    groups = _grouped(corr, bands)
    agree = np.clip(p**2 + (1 - p) ** 2, 1e-6, 1.0)
    costs = []
    for g in groups:
        own = corr[np.ix_(g, g)]
        thin = 1 - (own.sum() - len(g)) / max(1, len(g) * (len(g) - 1))
        same = float(np.exp(thin * np.log(agree[g]).sum()))
        costs.append({t: n * (n - 1) / 2 * min(1.0, same * 4.0**t) + n * 2.0**t for t in range(most + 1)})
    return groups, allocate(costs, bands * flips)[1]


def entries(fps: DataFrame, plan: tuple[list[list[int]], tuple[int, ...]]) -> DataFrame:
    """A row (key, th, n, f0..f3) for each partition and variant of each row (th, n, fp, margin).

    Each partition starts the fingerprint's words at another one, so that large buckets are cut at different places.
    """
    groups, flips = plan

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                fp, margin = _matrix(batch.column(2), BITS // 8), _matrix(batch.column(3), BITS)
                bits, words = np.unpackbits(fp, axis=1), np.ascontiguousarray(fp).view(np.int64)
                keys, who, rolled = [], [], []
                for b, (group, t) in enumerate(zip(groups, flips, strict=True)):
                    value = np.left_shift(np.uint64(1), np.arange(len(group), dtype=np.uint64))
                    key = bits[:, group].astype(np.uint64) @ value
                    soft = value[np.argsort(margin[:, group], axis=1, kind="stable")[:, :t]]
                    for v in range(1 << t):
                        flip = np.zeros(len(key), np.uint64)
                        for q in range(t):
                            if v >> q & 1:
                                flip ^= soft[:, q]
                        keys.append(mix(((key ^ flip) + np.uint64(b << 56)) * np.uint64(M)))
                        who.append(np.arange(len(key)))
                        rolled.append(np.roll(words, b, axis=1))
                who = np.concatenate(who)
                cols = [np.concatenate(keys).view(np.int64), batch.column(0).to_numpy()[who], batch.column(1).to_numpy()[who], *np.concatenate(rolled).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["key", "th", "n", "f0", "f1", "f2", "f3"])

    return fps.select("th", "n", "fp", "margin").where("n > 0").mapInArrow(of, "key bigint, th bigint, n int, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def _far(f: np.ndarray, n: np.ndarray, g: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Differing bits; more than any where the set sizes alone rule out a similarity of 0.8."""
    d = np.bitwise_count((f ^ g).view(np.uint64)).sum(-1, dtype=np.int64)  # of signed numbers it would count the absolute value's bits
    return np.where(5 * np.minimum(n, m) >= 4 * np.maximum(n, m), d, BITS + 1)


def _tree(n: np.ndarray, f: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """The links of the nearest-neighbour forest within ``tau`` bits (Prim's algorithm), by position."""
    best, link = np.full(len(n), BITS + 2, np.int64), np.zeros(len(n), np.int64)
    left = np.ones(len(n), bool)
    a, b = [], []
    for _ in range(len(n)):
        now = int(np.argmin(np.where(left, best, BITS + 3)))
        if best[now] <= tau:
            a.append(now), b.append(int(link[now]))
        left[now] = False
        d = _far(f, n, f[now], n[now])
        closer = d < best
        best[closer], link[closer] = d[closer], now
    return a, b


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, n: shingles of both) of the buckets in batches sorted by key; holds a block of a bucket at most beside the batch."""
    held: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        key, th, n, f = cols
        keep = len(key)
        if not last:  # the last bucket may go on in the next batch
            keep = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            if len(key) - keep > BLOCK:
                keep += (len(key) - keep - 1) // (BLOCK - 1) * (BLOCK - 1)
        rest = None if last else [c[keep:] for c in cols]
        # a block of a large bucket ends with the first member of the next
        end = min(keep + 1, len(key)) if not last and keep < len(key) and keep and key[keep - 1] == key[keep] else keep
        key, th, n, f = (c[:end] for c in cols)
        a, b = [], []
        if len(key):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            small = np.repeat(size <= SMALL, size)
            for d in range(1, min(SMALL, len(key))):
                x = np.flatnonzero((key[d:] == key[:-d]) & small[:-d])
                x = x[_far(f[x], n[x], f[x + d], n[x + d]) <= TAU]
                a.append(x), b.append(x + d)
            for s, z in zip(start[size > SMALL], size[size > SMALL], strict=True):
                for i in range(s, max(s + z - 1, s + 1), BLOCK - 1):
                    j = min(i + BLOCK, s + z)
                    x, y = _tree(n[i:j], f[i:j], TAU)
                    a.append(np.array(x, np.int64) + i), b.append(np.array(y, np.int64) + i)
        a, b = (np.concatenate(c or [np.zeros(0, np.int64)]) for c in (a, b))
        return [th[a], th[b], n[a].astype(np.int64) + n[b]], rest

    def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([lo, hi, n], 1)[lo < hi], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both.T], ["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(3)] + [np.stack([batch.column(i).to_numpy() for i in range(3, 7)], 1)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        found, held = pairs(cols, False)
        yield out(*found)
    if held is not None and len(held[0]):
        yield out(*pairs(held, True)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        th, texts = batch.column(0), batch.column(1)
        for i, j in slices(texts, 1 << 18):
            rows, hashes = shingles_of(texts.slice(i, j - i))
            cut = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([th.slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes.view(np.int64)))], ["th", "s"])


def common_shingles(texts: DataFrame, n: int, sample: int = 20_000, most: int = 200_000) -> np.ndarray:
    """Shingles that repeat in a sample of the texts, the rarest first.

    They only set the order of the prefix filter, which is without loss in any.
    """
    u = F.pmod(F.xxhash64("th", F.lit("order")), F.lit(1 << 20))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(0), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(shingles_of(batch.column(0).slice(i, j - i))[1].view(np.int64))], ["h"])

    counted = texts.where(u < max(1, (sample << 20) // max(n, 1))).select("text").mapInArrow(of, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    repeated = settle(counted.where("n > 1"), "common")
    rows = repeated.orderBy(F.desc("n"), "h").limit(most).collect()
    discard(repeated)
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """A row (key, th, n, pos) for each shingle in the prefix of each text; copies repeat."""
    order = np.argsort(common)
    names, ranks = common[order], order + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 18):
                rows, hashes = shingles_of(batch.column(1).slice(i, j - i))
                rank = np.zeros(len(rows), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                    rank = np.where(names[at] == hashes, ranks[at], 0)
                by = np.lexsort((hashes, rank, rows))
                n = np.bincount(rows, minlength=j - i)
                pos = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                of_row = n[rows]
                keep = pos <= of_row - (4 * of_row + 4) // 5
                th = batch.column(0).slice(i, j - i).to_numpy()[rows]
                cols = [hashes[by][keep].view(np.int64), th[keep], of_row[keep].astype(np.int32), pos[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "th", "n", "pos"])

    return texts.select("th", "text").mapInArrow(of, "key bigint, th bigint, n int, pos int")


def _shared(rows: DataFrame, by: str, total: int) -> DataFrame:
    """The ``rows`` whose key occurs with more than one ``by``, with ``rows_of_key``; counted before they are shuffled."""
    keys = rows.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count("*").alias("rows_of_key"))
    keys = settle(keys.where("lo <> hi").select("key", "rows_of_key"), "keys")
    return spread_join(rows, keys, "key", total)


def unjoined(texts: DataFrame, n: int, total: int, member: DataFrame) -> DataFrame:
    """Every pair (a, b, n: shingles of both) of texts in different groups of ``member`` that can have a similarity of 0.8, perhaps others.

    ``n`` is the number of different texts, ``total`` that of the prefixes' rows.
    """
    every = prefixes(texts, common_shingles(texts, n))  # made twice: that costs less than a table of it
    met = settle(_shared(every, "th", total).groupBy("key", "th").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "met")
    of_group = met.join(member.withColumnRenamed("node", "th"), "th", "left").select("key", "th", "n", "pos", F.coalesce("component", "th").alias("c"))
    of_group = settle(of_group, "of_group")
    heads = met.where(F.col("pos") < HEAD).groupBy("th").agg(*[F.max(F.when(F.col("pos") == i, F.col("key"))).alias(f"h{i}") for i in range(HEAD)])
    apart = _shared(of_group, "c", of_group.count()).join(heads, "th", "left")
    before = F.array_compact(F.array(*[F.when(F.col("pos") > i, F.col(f"h{i}")) for i in range(HEAD)]))
    apart = settle(apart.select("key", "th", "n", "pos", "c", "rows_of_key", before.alias("before")), "apart")
    discard(met, of_group)
    # a is the smaller of the two; at the first shingle they share, what follows it bounds what they have in common
    left = apart.where("9 * (n - pos) >= 8 * n").withColumn("salt", F.pmod(F.xxhash64("th"), F.ceil(F.col("rows_of_key") / TOGETHER)))
    right = apart.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("rows_of_key") / TOGETHER) - 1)))
    left, right = (side.select("key", "salt", *[F.col(c).alias(f"{c}_{x}") for c in ("th", "n", "pos", "c", "before")]) for side, x in ((left, "a"), (right, "b")))
    order = F.expr("n_a < n_b or n_a = n_b and th_a < th_b")
    able = 9 * F.least(F.expr("n_a - pos_a"), F.expr("n_b - pos_b")) >= 4 * F.expr("n_a + n_b")
    # a pair that shares one of its first shingles has met there
    met_before = F.arrays_overlap("before_a", "before_b")
    pairs = left.join(right, ["key", "salt"]).where(order & F.expr("5 * n_a >= 4 * n_b and c_a <> c_b") & able & ~met_before)
    found = settle(pairs.select(F.least("th_a", "th_b").alias("a"), F.greatest("th_a", "th_b").alias("b"), F.expr("cast(n_a as bigint) + n_b").alias("n")).distinct(), "unjoined")
    discard(apart)
    return found


def _parts(found: DataFrame, most: float) -> list[DataFrame]:
    """The pairs ``found`` (a, b, n) in parts of about ``most`` shingles."""
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = max(1, ceil(total / max(most, LEAST)))
    return [found.where(F.pmod(F.xxhash64("a", "b", F.lit("part")), F.lit(parts)) == i) for i in range(parts)]


def can_link(na: np.ndarray, a: pa.Array, nb: np.ndarray, b: pa.Array) -> np.ndarray:
    """Which pairs of sets, given by sizes and marks, can have a similarity of 0.8.

    Each bit that one set has and the other lacks is a shingle that they don't share.
    """
    out = np.zeros(len(na), bool)
    wide = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (a, b)], 1)
    for wa, wb in np.unique(wide, axis=0):
        at = np.flatnonzero((wide[:, 0] == wa) & (wide[:, 1] == wb))
        x, y = (np.bitwise_or.reduce(_matrix(c.take(pa.array(at)), w).reshape(len(at), -1, min(wa, wb)), axis=1).view(np.uint64) for c, w in ((a, wa), (b, wb)))
        in_a, in_b = (n[at] - np.bitwise_count(own & ~other).sum(1, dtype=np.int64) for n, own, other in ((na, x, y), (nb, y, x)))
        out[at] = 9 * np.minimum(in_a, in_b) >= 4 * (na[at] + nb[at])
    return out


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
        keep = pa.array(can_link(na, batch.column(3), nb, batch.column(5)))
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), batch.column(1), pa.array(na + nb))], ["a", "b", "n"])


def able(found: DataFrame, marks: DataFrame, total: int) -> DataFrame:
    """The pairs in ``found`` (a, b, n) that ``marks`` (th, n, marks) don't rule out; ``total`` is the number of all texts' shingles."""
    out = []
    for part in _parts(found, BY_MARKS * total):
        left, right = (marks.select(F.col("th").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}")) for x in "ab")
        pairs = part.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "ma", "nb", "mb")
        out.append(settle(pairs.mapInArrow(_able, "a bigint, b bigint, n bigint"), "able"))
    return reduce(DataFrame.unionByName, out)


def verified(found: DataFrame, marks: DataFrame, base: DataFrame, firsts: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b) in ``found`` (a, b, n) with a similarity of 0.8 or more."""
    out = []
    for part in _parts(able(found, marks, total), BY_SETS * total):
        wanted = part.select(F.explode(F.array("a", "b")).alias("th")).distinct()
        wanted = firsts.join(wanted, "th", "left_semi").select(F.col("th").alias("w"), F.col("first").alias("f"))
        texts = base.join(wanted, (base["th"] == wanted["w"]) & base["doc_id"].eqNullSafe(wanted["f"])).select("th", "text")
        sets = settle(texts.mapInArrow(_sets, "th bigint, s array<bigint>").dropDuplicates(["th"]), "sets")
        left, right = (sets.select(F.col("th").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        close = part.select("a", "b").join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")
        out.append(settle(close, "close"))
        discard(sets)
    return reduce(DataFrame.unionByName, out)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``th`` (a hash of the text), ``part`` (its group) and ``component_id``.

    Texts link if their sets of five-word shingles have a Jaccard similarity of
    0.8 or more (A-Z lower-cased, words are runs without ASCII white space, fewer
    than five words make one shingle). ``component_id`` is the smallest doc_id
    reachable; a null doc_id counts only where a group has no other. Equal texts
    are one from the start. Null and empty texts are equal; texts without words
    have no shingles and link only with equal ones. Repeated rows come back as
    often as they came in. An empty table gives an empty one.

    No link is lost and none is below 0.8, but for collisions of the 64-bit
    hashes of shingles and texts.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    prints = settle(base.mapInArrow(_fingerprints, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, th bigint, n int, fp binary, margin binary, marks binary"), "prints")
    distinct = settle(prints.groupBy("th").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "margin", "marks")]), "distinct")
    in_prefixes = prints.agg(F.sum(F.expr("if(n > 0, n - (4 * n + 4) div 5 + 1, 0)"))).first()[0] or 0
    ids, firsts = settle(prints.select("doc_id", "th"), "ids"), settle(distinct.select("th", "first"), "firsts")
    discard(prints)
    marks = settle(distinct.select("th", "n", "marks"), "marks")
    total = marks.agg(F.sum("n")).first()[0] or 0
    met = entries(distinct, plan_for(distinct)).repartitionByRange("key", "f0").sortWithinPartitions("key", "f0", "f1", "f2", "f3")
    found = settle(met.mapInArrow(_meet, "a bigint, b bigint, n bigint").distinct(), "candidates")
    discard(distinct)
    close = verified(found, marks, base, firsts, total)
    others = unjoined(base, firsts.count(), in_prefixes, components(close))
    more = verified(others, marks, base, firsts, total)
    discard(found, others, marks)
    member = components(close.union(more))
    fps = firsts.join(member, firsts["th"] == member["node"], "left").select("th", "first", F.coalesce("component", "th").alias("fp"))
    least = fps.groupBy("fp").agg(F.min("first").alias("component_id"), F.count("*").alias("rows_of_key"))
    named = spread_join(fps, least, "fp", firsts.count()).select("th", "fp", "component_id")
    copies = ids.groupBy("th").agg(F.count("*").alias("rows_of_key"))
    named = settle(named.join(copies, "th"), "named")
    return spread_join(ids, named, "th", ids.count()).select("doc_id", "th", F.col("fp").alias("part"), "component_id")
