"""SimHash near-duplicates, joined by the generalised pigeonhole principle.

Fingerprints within ``tau`` bits of each other are found without comparing all
pairs (Qin et al., 2018): correlated bits are grouped into m partitions and each
partition gets its own threshold t_i with sum(t_i) = tau - m + 1, so a pair
within tau must be within t_i in at least one partition (t_i = -1: partition not
probed). A dynamic programme picks the thresholds with the fewest estimated
candidates, from counts over all fingerprints. Index rows carry a partition's
bits, probes also all variants within t_i, and candidates are verified.

Only distinct fingerprints are joined: copies share one and are never paired.
Buckets too large to pair directly are split by a second pigeonhole over the
remaining bits, which loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, spread_join
from .components import components

SEED = 42
#: Pairs of a bucket up to which it is joined as it is; larger ones take a second key.
DIRECT = 64


def _bits_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The majority fingerprint of each run of ``hashes``; runs begin at ``starts`` and none is empty."""
    n = np.diff(np.append(starts, len(hashes)))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints_of(texts: list[str | None], k: int = 3, at_once: int = 1 << 16) -> np.ndarray:
    """64-bit fingerprints: majority bits over XXH64 (seed 42) of the k-word shingles, repeats included.

    A-Z is lower-cased and words are runs without ASCII white space. Fewer than
    k words make one shingle; no word (a null or empty text) gives 0. Long texts
    are taken in pieces of ``at_once`` shingles.
    """
    out = np.zeros(len(texts), np.uint64)
    digest, hashes, starts, rows = xxhash.xxh64_intdigest, [], [], []

    def flush() -> None:
        if rows:
            out[rows] = _bits_of(np.array(hashes, np.uint64), np.array(starts))
            hashes.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if not words:
            continue
        if len(words) - k + 1 > at_once:
            votes, n = np.zeros(64, np.int64), len(words) - k + 1
            for j in range(0, n, at_once):
                part = words[j : j + at_once + k - 1]
                h = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(part[q:] for q in range(k)), strict=False))], np.uint64)
                votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(votes * 2 > n).view(">u8")[0]
            continue
        rows.append(i)
        starts.append(len(hashes))
        if len(words) <= k:
            hashes.append(digest(b" ".join(words), SEED))
        else:
            hashes += [digest(s, SEED) for s in map(b" ".join, zip(*(words[q:] for q in range(k)), strict=False))]
        if len(hashes) > at_once:
            flush()
    flush()
    return out


def fingerprint(text: str | Column, k: int = 3) -> Column:
    """The fingerprint of a text column as a signed bigint (its 64 bits)."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        parts = [fingerprints_of(texts.slice(i, j - i).to_pylist(), k) for i, j in slices(texts)]
        return pa.array(np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64))

    return of.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


@dataclass(frozen=True)
class Plan:
    """``masks``: the bits of each partition; ``limits``: their thresholds, -1 for one that isn't probed."""

    masks: tuple[int, ...]
    limits: tuple[int, ...]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 1 << 14):
            bits = np.unpackbits(fp[i : i + (1 << 14)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])


def _grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of (nearly) equal size, each grown from a seed by highest correlation."""
    left, groups = set(range(len(corr))), []
    for g in range(m):
        size = (len(corr) - sum(map(len, groups))) // (m - g)
        order = sorted(left)
        seed = max(order, key=lambda b: (sum(sorted((corr[b, x] for x in order if x != b), reverse=True)[: size - 1]), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (sum(corr[b, x] for x in group), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds, one a partition, that sum to ``total`` at least cost, by dynamic programming."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for options in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in options.items():
                if (got := (c + extra, (*chosen, t))) < after.get(s + t, (np.inf, ())):
                    after[s + t] = got
        best = after
    return best[total]


def plan_for(fps: DataFrame, tau: int = 2, sizes: tuple[int, ...] = (2, 3, 4), probe_cost: float = 0.5) -> Plan:
    """Partitions and thresholds for the distinct fingerprints in ``fps`` (bigint column ``fp``).

    Bit counts and pairwise bit correlations come from all fingerprints; what
    reaches the driver is 64 x 64 sums. A partition's candidates at threshold t
    are estimated from each bit's chance to agree between two fingerprints.
    """
    n = max(fps.count(), 1)
    got = fps.mapInArrow(_moments, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    joint = np.zeros((64, 64))
    for r in got:
        joint[r["i"], r["j"]] = r["n"] / n
    p = np.diag(joint).copy()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))
    agree = np.clip(p**2 + (1 - p) ** 2, 1e-6, 1.0)
    options = []
    for m in sizes:
        groups = _grouped(corr, m)
        costs = []
        for g in groups:
            # groups of correlated bits agree more often than independent ones: the mean correlation thins the exponent
            own = corr[np.ix_(g, g)]
            thin = 1 - (own.sum() - len(g)) / max(1, len(g) * (len(g) - 1))
            none = float(np.exp(thin * np.log(agree[g]).sum()))
            odds = (1 - agree[g]) / agree[g]
            pairs = n * (n - 1) / 2
            cost, chance, probes = {-1: 0.0}, none, 1.0
            for t in range(tau + 1):
                if t:
                    chance += none * sum(float(np.prod(odds[list(c)])) for c in combinations(range(len(g)), t))
                    probes += len(list(combinations(g, t)))
                cost[t] = pairs * min(chance, 1.0) + probe_cost * n * (1 + probes)
            costs.append(cost)
        cost, limits = allocate(costs, tau - m + 1)
        options.append((cost, m, groups, limits))
    _, _, groups, limits = min(options, key=lambda x: (x[0], x[1]))
    return Plan(tuple(sum(1 << (63 - b) for b in g) for g in groups), limits)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _variants(mask: int, t: int) -> list[int]:
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [_signed(sum(c)) for k in range(t + 1) for c in combinations(bits, k)]


def links(fps: DataFrame, tau: int = 2, plan: Plan | None = None) -> DataFrame:
    """Pairs ``a < b`` of the distinct bigint fingerprints in column ``fp`` that differ in 1 to ``tau`` bits.

    Every such pair, each once; null fingerprints link with nothing.
    """
    plan = plan or plan_for(fps, tau)
    fps = fps.where("fp is not null")
    probes, index = [], []

    def probed(i: int, key: Column, flips: Column) -> Column:
        return F.transform(flips, lambda v: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(v).alias("key")))

    for i, (mask, t) in enumerate(zip(plan.masks, plan.limits, strict=True)):
        if t >= 0:
            key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
            index.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
            flips = F.array(*[F.lit(v) for v in _variants(mask, t)])
            probes.append(probed(i, key, flips))
    index = fps.select("fp", F.explode(F.array(*index)).alias("k")).select("fp", "k.part", "k.key")
    size = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > DIRECT).select("part", "key")
    probe = fps.select("fp", F.explode(F.flatten(F.array(*probes))).alias("k")).select("fp", "k.part", "k.key")
    # a bucket with many fingerprints is keyed again by the other bits, cut into tau + 1 pieces of which one must agree
    rest = []
    for mask in plan.masks:
        other = [b for b in range(64) if not mask >> b & 1]
        rest.append([_signed(sum(1 << b for b in other[q :: tau + 1])) for q in range(tau + 1)])
    inner = F.explode(F.element_at(F.array(*[F.array(*[F.struct(F.lit(q).alias("q"), F.lit(v).alias("v")) for q, v in enumerate(r)]) for r in rest]), F.col("part") + 1))

    def again(df: DataFrame) -> DataFrame:
        kept = df.join(large, ["part", "key"], "left_semi")
        return kept.select("fp", "part", "key", inner.alias("r")).select("fp", "part", "key", F.col("r.q").alias("q"), F.col("fp").bitwiseAND(F.col("r.v")).alias("sub"))

    def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        l, r = left.withColumnRenamed("fp", "a"), right.withColumnRenamed("fp", "b")
        far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        return l.join(r, keys).where((F.col("a") < F.col("b")) & (far <= tau)).select("a", "b")

    small = size.where((F.col("n") <= DIRECT)).select("part", "key")
    few = index.join(small, ["part", "key"], "left_semi")
    return pairs(probe, few, ["part", "key"]).union(pairs(again(probe), again(index), ["part", "key", "q", "sub"])).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, tau: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``th`` (a hash of the text), ``fp``, ``component_id`` and ``part``.

    ``part`` names the component, even where ids repeat or are null; ``fp`` is the fingerprint's 16 hex digits. ``component_id`` is the smallest
    doc_id among all documents reachable over links of ``tau`` bits or fewer,
    the row's own included. Null and empty texts have fingerprint 0 and link
    like any other; rows with a null doc_id keep it and count for a component's
    smallest id only if it has no other (then it is null). Repeated rows come
    back as often as they came in. An empty table gives an empty one.
    """
    base = settle(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), fingerprint(text, k).alias("fp")), "fingerprints")
    fps = settle(base.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    member = components(links(fps.select("fp"), tau))
    total = fps.count()
    fps = fps.join(member, fps["fp"] == member["node"], "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("component"))
    least = fps.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("rows_of_key"))
    named = spread_join(fps, least, "component", total).select("fp", "component_id", F.col("component").alias("part"), F.col("copies").alias("rows_of_key"))
    return spread_join(base, settle(named, "named"), "fp", base.count()).select("doc_id", "th", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"), "component_id", "part")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with its smallest doc_id.

    ``near`` names the components as ``near_duplicates`` does, which is also what
    gives them by default. Of a component's rows that share that doc_id (null:
    only if all in it are null) one stays: the one with the smallest hash of its
    text, and of those equal in both the one whose columns as JSON come first.
    Columns stay as they are, whatever their names. Null and empty texts are
    equal; an empty table gives an empty one.
    """
    tag = f"_{uuid.uuid4().hex}"
    near = near_duplicates(docs, doc_id, text) if near is None else near
    keep = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # ids may repeat in other components, which keep their own row
    keep = keep.groupBy("component_id", "part").agg(F.min("th").alias("th"), F.count("*").alias("n"))
    keep = keep.select(F.col("component_id").alias(f"id{tag}"), F.col("th").alias(f"th{tag}"), F.col("n").alias(f"n{tag}"))
    own = docs.withColumn(f"own{tag}", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    out = own.join(keep, own[doc_id].eqNullSafe(keep[f"id{tag}"]) & (own[f"own{tag}"] == keep[f"th{tag}"]))
    whole = F.struct(*[own[c] for c in docs.columns])
    several = out.where(F.col(f"n{tag}") > 1).groupBy(own[doc_id], own[f"own{tag}"]).agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias(f"row{tag}"))
    return out.where(F.col(f"n{tag}") == 1).select(*[own[c] for c in docs.columns]).union(several.select(f"row{tag}.*"))
