"""A quality classifier by co-training.

Two views of a document, the content of its text and its metadata, train a
classifier each. In every round each classifier goes over all unlabelled documents and labels
those it is surest of, for the other one to learn from. Both views are calibrated on
labelled rows kept apart, and a logistic combination scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fold, joined_bytes, settle, slices
from .words import words_of

SLICE = 1 << 19
WORD_BUCKETS = 256
META_BUCKETS = 64


def content_features(texts: pa.Array) -> np.ndarray:
    """Of each whole text: square roots of the shares of its bytes and of its words' hash buckets, and of repeated words."""
    out = np.zeros((len(texts), 256 + WORD_BUCKETS + 2))
    for i, j in slices(texts, SLICE):
        buf, off = joined_bytes(texts.slice(i, j - i))
        n = j - i
        row = np.repeat(np.arange(n), np.diff(off))
        chars = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256)
        h, _, _, at = words_of(buf, off)
        words = np.bincount(at * WORD_BUCKETS + (h >> np.uint64(56)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        order = np.lexsort((h, at))
        again = np.zeros(len(h), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1])
        repeated = np.bincount(at[order][again], minlength=n)
        total = np.maximum(words.sum(1), 1)
        out[i:j, :256] = np.sqrt(chars / np.maximum(chars.sum(1), 1)[:, None])
        out[i:j, 256 : 256 + WORD_BUCKETS] = np.sqrt(words / total[:, None])
        out[i:j, -2] = repeated / total
        out[i:j, -1] = np.log1p(total) / 10
    return out


def _hashed(value: object, buckets: int) -> np.ndarray:
    """A one-hot bucket of a value's text; null is a value of its own."""
    return np.eye(buckets)[zlib.crc32(("\0" if value is None else str(value)).encode()) % buckets]


def metadata_features(source: list, lang: list, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Of each row: buckets of source, language, length and line count, and mean line length."""
    seen = {v: _hashed(v, META_BUCKETS) for v in {*source, *lang}}
    size = np.log2(np.maximum(chars, 1))
    per = np.log2(np.maximum(chars / np.maximum(lines, 1), 1))
    steps = [np.eye(24)[np.clip(x, 0, 23).astype(int)] for x in (size, np.log2(np.maximum(lines, 1)), per * 2)]
    return np.concatenate([np.array([seen[v] for v in source]).reshape(-1, META_BUCKETS), np.array([seen[v] for v in lang]).reshape(-1, META_BUCKETS), *steps, (per / 10)[:, None]], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, b = np.ones(len(x)) if weight is None else weight, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        s = w * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _line(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(x @ b[:-1] + b[-1], -30, 30)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass(frozen=True)
class Model:
    """Coefficients of both views, their calibrations (slope, constant), and of the combination."""

    views: tuple[np.ndarray, np.ndarray]
    scales: tuple[np.ndarray, np.ndarray]
    joint: np.ndarray

    def scores(self, features: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [_line(_line(x, b)[:, None], s) for x, b, s in zip(features, self.views, self.scales, strict=True)]
        return _p(z[0]), _p(z[1]), _p(_line(np.stack(z, axis=1), self.joint))


def cotrain(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pick: Callable, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients of both views after ``rounds`` of exchanging pseudo-labels.

    ``pick(models, handed)`` gives a view, label, key and both views' features of
    each row that a view is surest of, without the keys it has handed over before.
    """
    extra: list[list[tuple[float, np.ndarray]]] = [[], []]
    handed: list[list[int]] = [[], []]
    models = [logistic(labelled[v], y) for v in (0, 1)]
    for _ in range(rounds):
        picked = pick(models, handed)
        if not picked:
            break
        for v, label, key, features in picked:
            handed[v].append(key)
            extra[1 - v].append((label, features[1 - v]))
        for v in (0, 1):
            if extra[v]:
                told = np.array([label for label, _ in extra[v]])
                weight = np.concatenate([np.ones(len(y)), np.full(len(told), 0.3)])
                models[v] = logistic(np.concatenate([labelled[v], np.stack([x for _, x in extra[v]])]), np.concatenate([y, told]), weight)
    return models[0], models[1]


#: Features of the text's view in a stored row; those of the metadata follow.
CONTENT = 256 + WORD_BUCKETS + 2


def _stored(a: np.ndarray, b: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(np.concatenate([a, b], axis=1).astype(np.float16))
    width = x.shape[1] * 2
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(x.tobytes())])


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(float)
    return x[:, :CONTENT], x[:, CONTENT:]


def _surest(models: list[np.ndarray], handed: list[list[int]], each: int, sure: float):
    """Of all batches the ``each`` rows that each view is surest of, for either label; equal keys are one row, ties go to smaller keys."""
    gone = [np.array(sorted(h), np.int64) for h in handed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, float], tuple] = {}
        for batch in batches:
            keys, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            views, x = _read(batch.column(1)), batch.column(1)
            for v in (0, 1):
                p = _p(_line(views[v][first], models[v]))
                for label in (0.0, 1.0):
                    own = np.round(p if label else 1 - p, 12)
                    at = np.flatnonzero((own >= sure) & ~np.isin(keys, gone[v]))
                    conf, key, row = own[at], keys[at], [x[int(first[i])].as_py() for i in at[np.lexsort((keys[at], -own[at]))][:each]]
                    order = np.lexsort((key, -conf))[:each]
                    conf, key = conf[order], key[order]
                    if (v, label) in best:
                        c, k, r = best[v, label]
                        conf, key, row = np.concatenate([c, conf]), np.concatenate([k, key]), r + row
                        _, one = np.unique(key, return_index=True)
                        one = one[np.lexsort((key[one], -conf[one]))][:each]
                        conf, key, row = conf[one], key[one], [row[i] for i in one]
                    best[v, label] = conf, key, row
        for (v, label), (conf, key, row) in best.items():
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), v, np.int32)), pa.array(np.full(len(key), label)), pa.array(conf), pa.array(key), pa.array(row, pa.binary())], ["v", "label", "conf", "th", "x"])

    return run


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str, lang: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), t.alias("t"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))


def _features(t: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = joined_bytes(t)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    return content_features(t), metadata_features(source.to_pylist(), lang.to_pylist(), np.diff(off), breaks[off[1:]] - breaks[off[:-1]] + 1)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality", examples: int = 3000, each: int = 200, sure: float = 0.95) -> Model | None:
    """Learns from rows outside the held-out fold (crc32 of the id mod 4 = 2); None without rows of both labels.

    About ``examples`` labelled rows at most are read, picked by a hash of their
    id; a third of them calibrates. All unlabelled rows are the pool: in a round
    each view hands over at most ``each`` a label, those it is surest of among
    all, with probability ``sure`` at least. Equal texts with equal metadata are
    one row there and are handed over once. Ties go to the smaller hash of text
    and metadata, so neither row order nor partitions decide them. Features are
    made once, on the executors; the driver gets those of examples and picked rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(fold(F.col("id")) != 2)
    tagged = known.count()
    if not tagged:
        return None

    def made(batches):
        for batch in batches:
            for i, j in slices(batch.column(0), SLICE):
                x = _stored(*_features(*(batch.column(q).slice(i, j - i) for q in (0, 1, 2))))
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(i, j - i), batch.column(4).slice(i, j - i), x], ["id", "th", "x"])

    rows = _narrow(docs, doc_id, text, source, lang).where((fold(F.col("id")) != 2) & F.col("id").isNotNull())
    rows = rows.select("t", "source", "lang", "id", F.xxhash64("t", "source", "lang").alias("th"))
    rows = rows.mapInArrow(made, f"id {docs.schema[doc_id].dataType.simpleString()}, th bigint, x binary")
    rows = settle(rows.join(known, "id", "left"), "features")
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    part = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(3))
    got = rows.where(F.col("y").isNotNull() & (u < examples / tagged)).select("y", part.cast("int").alias("part"), F.col("id").cast("string").alias("id"), "th", "x").toArrow().combine_chunks()
    if not len(got):
        return None
    order = np.lexsort((got.column("th").to_numpy(), got.column("id").to_pandas().to_numpy(str)))
    y, cal = got.column("y").to_numpy()[order].astype(float), got.column("part").to_numpy()[order] == 0
    views = tuple(x[order] for x in _read(got.column("x")))
    train, hold = ~cal, cal
    if len(set(y[train].tolist())) < 2 or len(set(y[hold].tolist())) < 2:
        return None
    pool = rows.where("y is null").select("th", "x")

    def pick(models: list[np.ndarray], handed: list[list[int]]) -> list[tuple]:
        near = pool.mapInArrow(_surest(models, handed, each, sure), "v int, label double, conf double, th bigint, x binary").dropDuplicates(["v", "label", "th"])
        rank = F.row_number().over(Window.partitionBy("v", "label").orderBy(F.desc("conf"), "th"))
        best = near.withColumn("r", rank).where(F.col("r") <= each).collect()
        return [(r["v"], r["label"], r["th"], tuple(f[0] for f in _read(pa.array([bytes(r["x"])], pa.binary())))) for r in sorted(best, key=lambda r: (r["v"], r["label"], r["r"]))]

    own = cotrain(tuple(x[train] for x in views), y[train], pick)
    discard(rows)
    z = [_line(x[hold], b) for x, b in zip(views, own, strict=True)]
    scales = tuple(logistic(a[:, None], y[hold], ridge=0.1) for a in z)
    joint = logistic(np.stack([_line(a[:, None], s) for a, s in zip(z, scales, strict=True)], axis=1), y[hold], ridge=0.1)
    return Model(own, scales, joint)


def scored(docs: DataFrame, model: Model | None, text: Column, source: Column, lang: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score_text double, score_meta double, score double")
    def of(t: pa.Array, s: pa.Array, g: pa.Array) -> pa.Array:
        out = []
        for i, j in slices(t, SLICE):
            part = [x.slice(i, j - i) for x in (t, s, g)]
            out.append(shared.value.scores(_features(*part)) if shared.value else (np.full(j - i, 0.5),) * 3)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([o[q] for o in out] or [np.zeros(0)])) for q in range(3)], ["score_text", "score_meta", "score"])

    return of.asNondeterministic()(F.coalesce(text, F.lit("")), source.cast("string"), lang.cast("string"))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality", out: str = "quality", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: ``score_text``, ``score_meta`` and ``score``, each 0 to 1.

    Every row is scored on its whole text and its metadata; null and empty texts
    and null metadata count as values of their own. All scores are 0.5 if
    nothing can be learned. Rows stay as they are, repeated ones too; a column
    named ``out`` is replaced, others pass through.
    """
    model = fit(docs, labels, doc_id, text, source, lang, label, **options)
    return docs.withColumn(out, scored(docs, model, F.col(text), F.col(source), F.col(lang)))
