"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over the cells of all dimensions (source, language,
topic). Raking scales the cells' weights to each dimension's target marginal in
turn until all hold. Documents are then sampled by calibrated probabilities:
p = min(1, c w), with c such that the expected tokens meet the wanted share.
"""

from __future__ import annotations

import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, discard, joined_bytes, settle, slices
from .words import words_of

#: Cells up to which raking runs on the driver; more of them are raked as a table.
DRIVER_CELLS = 100_000
#: Raking ends when no marginal is off by more than this share of the tokens, or after as many rounds.
CLOSE, ROUNDS = 1e-9, 500
TOPICS = 8


def profile(text: str | Column, topics: int = TOPICS) -> Column:
    """``tokens`` (words) and ``topic`` of a whole text.

    The topic is a bucket of the text's most frequent word of five bytes or
    more (ties: the smaller hash); -1 for a text without one.
    """

    @F.arrow_udf("tokens bigint, topic int")
    def of(texts: pa.Array) -> pa.Array:
        tokens, topic = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int32)
        for i, j in slices(texts, 1 << 19):
            h, first, end, row = words_of(*joined_bytes(texts.slice(i, j - i)))
            tokens[i:j] = np.bincount(row, minlength=j - i)
            long = end - first >= 5
            h, row = h[long], row[long]
            if not len(h):
                continue
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
            n = np.diff(np.append(start, len(h)))
            best = np.lexsort((h[start], -n, row[start]))
            r = row[start][best]
            lead = np.concatenate([[True], r[1:] != r[:-1]])
            topic[i + r[lead]] = (h[start][best][lead] >> np.uint64(20)) % np.uint64(topics)
        return pa.StructArray.from_arrays([pa.array(tokens), pa.array(topic)], ["tokens", "topic"])

    return of.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def marginal(shares: dict, target: dict | float) -> dict:
    """Target shares over the values that occur: weights given by value, or a power of the observed share (0: even)."""
    raw = {v: (float(target.get(v, 0.0)) if isinstance(target, dict) else s**target) for v, s in shares.items()}
    total = sum(raw.values())
    return {v: x / total for v, x in raw.items()} if total > 0 else {v: 1 / len(raw) for v in raw}


def _left_open(off: float, rounds: int) -> None:
    warnings.warn(f"a marginal is still off by {off:.3g} of the tokens after {rounds} rounds: the cells may not allow these targets", stacklevel=3)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Cell weights w such that tokens x w has the target marginals (as far as the cells allow; a gap that is left gives a warning)."""
    w, off = np.ones(len(tokens)) / max(tokens.sum(), 1e-300), 0.0
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, tokens * w, minlength=len(target))
            factor = np.where(now > 0, target / np.where(now > 0, now, 1), 0.0)
            off = max(off, np.abs(now - target)[now > 0].max(initial=0.0))
            w = w * factor[code]
        if off < close:
            return w
    _left_open(off, rounds)
    return w


def calibrate(tokens: np.ndarray, w: np.ndarray, share: float) -> float:
    """The c with sum(tokens min(1, c w)) = share of all tokens, or of what positive weights can give."""
    use = (w > 0) & (tokens > 0)
    t, v = tokens[use].astype(float), w[use]
    if not len(t):
        return 0.0
    want = share * tokens.sum()
    order = np.argsort(-v, kind="stable")
    t, v = t[order], v[order]
    full = np.concatenate([[0.0], np.cumsum(t)])
    rest = np.concatenate([np.cumsum((t * v)[::-1])[::-1], [0.0]])
    for i in range(len(t)):  # the first i cells are taken whole
        c = (want - full[i]) / rest[i] if rest[i] > 0 else np.inf
        if c * v[i] <= 1:
            return max(c, 0.0)
    return 1 / v[-1]


def _rake_table(cells: DataFrame, dims: list[str], targets: dict[str, dict | float], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``rake`` where the cells are too many for the driver: each dimension is an aggregation and a join."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = settle(cells.withColumn("w", F.lit(1.0 / total)), "cells")
    goals, tag = {}, f"_{uuid.uuid4().hex}"
    for d in dims:
        seen = now.groupBy(d).agg(F.sum("tokens").alias(f"n{tag}"))
        t = targets[d]
        if isinstance(t, dict):
            table = now.sparkSession.createDataFrame([(k, float(x)) for k, x in t.items()], f"`{d}` {dict(now.dtypes)[d]}, raw{tag} double")
            raw = seen.join(table, seen[d].eqNullSafe(table[d]), "left").select(seen[d], F.coalesce(f"raw{tag}", F.lit(0.0)).alias(f"raw{tag}"))
        else:
            raw = seen.select(d, F.pow(F.col(f"n{tag}") / F.lit(float(total)), F.lit(float(t))).alias(f"raw{tag}"))
        norm, values = raw.agg(F.sum(f"raw{tag}"), F.count("*")).first()
        share = F.col(f"raw{tag}") / norm if norm else F.lit(1.0 / max(1, values))
        goals[d] = settle(raw.select(d, share.alias(f"goal{tag}")), "goal")
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            have = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("w")).alias(f"have{tag}"))
            factor = have.join(goals[d], have[d].eqNullSafe(goals[d][d])).select(have[d].alias(f"d{tag}"), f"have{tag}", f"goal{tag}")
            factor = settle(factor, "factors")
            gap = factor.where(F.col(f"have{tag}") > 0).agg(F.max(F.abs(F.col(f"have{tag}") - F.col(f"goal{tag}")))).first()[0]
            off = max(off, gap or 0.0)
            scale = F.when(F.col(f"have{tag}") > 0, F.col(f"goal{tag}") / F.col(f"have{tag}")).otherwise(0.0)
            after = settle(now.join(factor, now[d].eqNullSafe(F.col(f"d{tag}"))).select(*[now[c] for c in dims], "tokens", (F.col("w") * scale).alias("w")), "cells")
            discard(now, factor)
            now = after
        if off < close:
            break
    else:
        _left_open(off, rounds)
    discard(*goals.values())
    return now


def _calibrate_table(cells: DataFrame, share: float) -> float:
    """``calibrate`` for a table of cells, to 12 digits."""
    total, least = cells.agg(F.sum("tokens"), F.min(F.when(F.col("w") > 0, F.col("w")))).first()
    if least is None:
        return 0.0
    lo, hi = 0.0, 1.0 / least
    while hi - lo > 1e-13 * hi:  # each round tries 16 values in one aggregation
        tries = [lo + (hi - lo) * i / 16 for i in range(17)]
        got = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("w") * float(c))) for c in tries]).first()
        at = next((i for i, g in enumerate(got) if g >= share * total), 16)
        lo, hi, before = tries[max(0, at - 1)], tries[at], (lo, hi)
        if (lo, hi) == before:
            break
    return hi


def mix(docs: DataFrame, targets: dict[str, dict | float], tokens: str = "tokens", share: float = 0.5, key: tuple[str, ...] = ("doc_id",), seed: int = 0) -> DataFrame:
    """A sample of ``docs`` whose expected token weights have the target marginals.

    ``targets`` maps columns of ``docs`` to their marginal: weights by value
    (values without one get none), or a power applied to the observed shares. A
    null is a value of its own. ``share`` is the sample's expected part of all
    tokens. Added columns: ``probability``, and ``weight``, which is 1 except
    where a document's wanted weight exceeds what including it once can give.
    Rows with the same ``key`` share their fate. Rows without tokens (null or 0)
    are left out, and an empty table gives an empty one.
    """
    dims = list(targets)
    n = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))
    cells = docs.where(n > 0).groupBy(*dims).agg(F.sum(n).alias("tokens"))
    rows = bounded_rows(cells, DRIVER_CELLS)
    spark = docs.sparkSession
    tag = uuid.uuid4().hex[:8]
    names = [f"__{tag}_{i}" for i in range(len(dims))]
    if rows is not None:
        rows = sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r[:-1]))
        count = np.array([r["tokens"] for r in rows], float)
        codes, goals = [], []
        for d in dims:
            values = sorted({r[d] for r in rows}, key=lambda x: (x is None, str(x)))
            place = {v: i for i, v in enumerate(values)}
            code = np.array([place[r[d]] for r in rows], np.int64)
            have = np.bincount(code, count, minlength=len(values))
            goal = marginal({v: have[i] / have.sum() for v, i in place.items()}, targets[d])
            codes.append(code)
            goals.append(np.array([goal[v] for v in values]))
        w = rake(count, codes, goals)
        c = calibrate(count, w, share)
        kind = ", ".join(f"{a} {dict(docs.dtypes)[d]}" for a, d in zip(names, dims, strict=True))
        table = F.broadcast(spark.createDataFrame([(*r[:-1], float(c * x)) for r, x in zip(rows, w, strict=True)], f"{kind}, __{tag}_w double"))
    else:
        raked = _rake_table(cells, dims, targets)
        c = _calibrate_table(raked, share)
        table = raked.select(*[F.col(d).alias(a) for a, d in zip(names, dims, strict=True)], (F.col("w") * float(c)).alias(f"__{tag}_w"))
    on = F.lit(True)
    for a, d in zip(names, dims, strict=True):
        on &= docs[d].eqNullSafe(table[a])
    p = F.least(F.lit(1.0), F.col(f"__{tag}_w"))
    u = (F.xxhash64(*[F.col(k) for k in key], F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    own = [docs[c] for c in docs.columns if c not in ("probability", "weight")]
    return docs.where(n > 0).join(table, on).where(u < p).select(*own, p.alias("probability"), F.greatest(F.lit(1.0), F.col(f"__{tag}_w")).alias("weight"))


#: Production targets: sources and languages flattened by a power of their share, topics even.
TARGETS: dict[str, dict | float] = {"source": 0.5, "lang": 0.7, "topic": 0.0}


def sample_documents(docs: DataFrame, share: float = 0.5, targets: dict[str, dict | float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``mix`` over documents, with tokens and topic taken from the text (columns of those names are replaced).

    Null and empty texts have no tokens and are left out. Rows with the same id
    share their fate, null ids too. Null sources and languages are values of their own.
    """
    own = f"profile_{uuid.uuid4().hex}"
    got = docs.withColumn(own, profile(text)).withColumns({"tokens": F.col(f"{own}.tokens"), "topic": F.col(f"{own}.topic")}).drop(own)
    return mix(got, targets, share=share, key=(doc_id,))
