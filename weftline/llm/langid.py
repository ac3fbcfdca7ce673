"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of its positions, one bit for each
language. Reading an n-gram's k positions and combining the words with AND gives
at once the set of all languages whose filter contains it. Over a text, the
bits are counted by language; each count is corrected for the false positives
that the fill of that language's filter predicts, and the largest share decides.

A language's filter holds its characteristic n-grams: frequent there, and
nowhere else much more frequent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fold, settle, slices

UNKNOWN = "und"
SIZES = (3, 4)
#: Texts are taken in pieces of this many characters.
PIECE = 1 << 18
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased words, the row of each, and which rows hold a letter.

    Words are runs of letters with a blank on either side; no n-gram spans two blanks.
    """
    full = "\0".join(["", *(t or "" for t in texts), ""]).lower()
    cp = np.frombuffer(full.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = cp == 0
    row = np.maximum(np.cumsum(ends) - ends - 1, 0)  # a separator belongs to the text before it
    if int(ends.sum()) != len(texts) + 1:  # a text holds the separator itself
        low = [(t or "").lower() for t in texts]
        row = np.concatenate([np.zeros(1, np.int64), np.repeat(np.arange(len(texts)), [len(t) + 1 for t in low])])
    letter = _letters()[cp]
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word stands for all that is no letter
    c = np.where(letter, cp, 0)[keep].astype(np.uint64)
    r = row[keep].astype(np.int32)
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    hashes, rows = [], []
    pad = np.concatenate([np.zeros(1, np.uint64), c])
    prow = np.concatenate([r[:1], r])
    for n in SIZES:
        if len(pad) < n:
            continue
        h = np.full(len(pad) - n + 1, n, np.uint64)
        inner = np.ones(len(h), bool)
        for q in range(n):
            part = pad[q : q + len(h)]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            if 0 < q < n - 1:
                inner &= part != 0
        # the blank before a text's first word is the one after the previous text's last word
        hashes.append(_mixed(h[inner]))
        rows.append(prow[n - 1 :][inner])
    return np.concatenate(hashes), np.concatenate(rows), has


@dataclass(frozen=True)
class Model:
    """``words``: the filter, positions x 64-bit words of language bits; ``false``: each language's false-positive rate."""

    langs: tuple[str, ...]
    words: np.ndarray
    false: np.ndarray
    k: int

    def positions(self, h: np.ndarray) -> Iterator[np.ndarray]:
        m = np.uint64(len(self.words) - 1)
        step = (h >> np.uint64(40)) | np.uint64(1)
        for i in range(self.k):
            yield ((h + step * np.uint64(i)) & m).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The set of languages containing each n-gram, as rows of 64-bit words."""
        got = None
        for at in self.positions(h):
            got = self.words[at] if got is None else got & self.words[at]
        return got

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: n-grams, n-grams by language, and whether it holds a letter."""
        h, rows, has = grams(texts)
        total = np.bincount(rows, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        if len(h):
            masks = self.masks(h)
            for j in range(len(self.langs)):
                bit = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                hits[:, j] = np.bincount(rows[bit.astype(bool)], minlength=len(texts))
        return total, hits, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits, has = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), bool)
        short = [t if t is None or len(t) <= PIECE else "" for t in texts]
        for i, t in enumerate(texts):
            if t and len(t) > PIECE:
                for at in range(0, len(t), PIECE):
                    a, b, c = self.counts([t[at : at + PIECE]])
                    total[i] += a[0]
                    hits[i] += b[0]
                    has[i] |= c[0]
        a, b, c = self.counts(short)
        total, hits, has = total + a, hits + b, has | c
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(1)
        top = share[np.arange(len(texts)), best]
        score = np.where(has & (top > 0), top / np.maximum(share.sum(1), 1e-12), 0.0)
        return [self.langs[j] if h else UNKNOWN for j, h in zip(best, has, strict=True)], score


def filters(langs: tuple[str, ...], own: list[np.ndarray], bits_each: int = 16, k: int = 4) -> Model:
    """The filter of all languages together, from the n-grams of each."""
    size = 1 << max(10, int(np.ceil(np.log2(max(1, *map(len, own)) * bits_each))))
    model = Model(langs, np.zeros((size, (len(langs) + 63) // 64), np.uint64), np.zeros(len(langs)), k)
    for j, h in enumerate(own):
        for at in model.positions(h):
            model.words[at, j // 64] |= np.uint64(1 << (j % 64))
        fill = ((model.words[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean()
        model.false[j] = min(fill**k, 0.99)
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 3000, grams_each: int = 40_000, bits_each: int = 16, k: int = 4) -> Model | None:
    """Learns from rows outside the held-out fold (crc32 of the id mod 4 = 2) with a language; None if there are none.

    At most about ``per_lang`` rows a language are read as examples: rows are
    picked by a hash of their id, in proportion to the language's count. Each
    language's filter takes its ``grams_each`` most frequent characteristic
    n-grams (at least half as frequent there as in any other language), so the
    model grows with the number of languages alone. N-grams seen once count only
    for languages that have no others. Languages are all values of ``lang``.
    """
    own = docs.where((fold(doc_id) != 2) & F.col(lang).isNotNull())
    counts = own.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()
    if not counts:
        return None
    langs = tuple(r[0] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_lang / r[1]))])
    u = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = own.where(u < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                names = batch.column(0).slice(i, j - i).to_pylist()
                h, rows, _ = grams(batch.column(1).slice(i, j - i).to_pylist())
                kinds = sorted(set(names))
                which = np.array([kinds.index(x) for x in names])[rows] if len(rows) else np.zeros(0, np.int64)
                for q, name in enumerate(kinds):
                    g, n = np.unique(h[which == q], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    n = sample.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    n = seen = settle(n, "grams")
    scarce = [r["lang"] for r in n.groupBy("lang").agg(F.max("n").alias("most")).where("most = 1").collect()]
    n = n.where((F.col("n") > 1) | F.col("lang").isin(scarce)) if scarce else n.where("n > 1")
    totals = {r["lang"]: r["n"] for r in n.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model(langs, np.zeros((2, 1), np.uint64), np.zeros(len(langs)), k)
    rate = F.col("n") / F.create_map(*[F.lit(x) for a, b in totals.items() for x in (a, float(b))])[F.col("lang")]
    rated = n.withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where("rate * 2 >= top")
    ranked = rated.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams_each)
    chosen = ranked.select("lang", "gram").toPandas()
    discard(seen)
    return filters(langs, [chosen.gram[chosen.lang == name].to_numpy(np.int64).view(np.uint64) for name in langs], bits_each, k)


KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predicted(text: str | Column, model: Model | None, spark) -> Column:
    """``lang_pred`` and ``score`` (0 to 1) of a text column; the model is broadcast (its size is bounded, see ``fit``)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for i, j in slices(texts, 1 << 18):
            part = texts.slice(i, j - i).to_pylist()
            if shared.value is None:
                a, b = [UNKNOWN] * len(part), [0.0] * len(part)
            else:
                a, b = shared.value.predict(part)
            names += a
            scores += list(b)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(KIND))

    return of.asNondeterministic()(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang_pred`` and ``score`` of the whole text.

    A null text or one without a letter is ``und`` with score 0, and so is every
    text if nothing could be learned. Predictions use the text alone. Ties go to
    the language with more examples, then by name. Other columns pass through
    (one named ``out`` is replaced); repeated rows stay.
    """
    model = model or fit(docs, doc_id, text, lang)
    return docs.withColumn(out, predicted(text, model, docs.sparkSession))


def keep_known(docs: DataFrame, least: float = 0.0, **columns) -> DataFrame:
    """The rows whose text has a language: not ``und``, and a score above ``least``; columns stay as they are."""
    own = f"language_{uuid.uuid4().hex}"
    found = identify(docs, out=own, **columns)
    return found.where((F.col(f"{own}.lang_pred") != UNKNOWN) & (F.col(f"{own}.score") > least)).drop(own)
