"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors lexicographically by concatenated random hashes
(signs of random projections) and compares every vector with the few that
follow it in that order; the spanning forest of the verified pairs is kept.
Forests of all passes are united into components. How many passes it takes
depends on how crowded the space is, so it is measured: each round compares a
query set of its own with all vectors, and passes with longer windows are added until a
fresh set finds its links inside the components. What the sets missed is added
after the last round only, so it can't flatter a measurement.

Links are then counted exactly inside each component, block against block.
Blocks are cut in the order of a projection and have a centre and a radius;
where those of two blocks, or of two runs of blocks, settle whether all or none
link, no vector is moved. What is left is compared vector by vector.

Exact copies are one class from the start and never paired with each other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread_join
from .components import _forest, components

BITS = 62
#: Vectors in a block of a component.
BLOCK = 1024
#: Blocks in a run, which is settled as a whole where it can be.
RUN = 64
#: Vectors of the first round's query set; each round's is new and twice as large, up to eight times.
QUERIES = 512
#: Places that a window has at most; each round's windows are four times as long, as a crowded space needs.
WIDEST = 1024
#: Vectors that are compared with their windows at once.
ROWS = 256
#: Passes whose rows are shuffled in one job.
AT_ONCE = 8


def passes_for(n: int, window: int, least: float, recall: float) -> int:
    """Passes after which a pair at exactly ``least`` has met with probability ``recall``.

    A pair meets in a pass if it agrees on the bits that n vectors take to be
    told apart down to one window.
    """
    bits = math.log2(max(2.0, n / window))
    meets = (1 - math.acos(least) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).standard_normal((dim, BITS))


def _matrix(lists: pa.Array) -> tuple[np.ndarray, int]:
    """Unit vectors, in double precision, of a list array whose lists have one length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True), x.shape[1]


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows in which all keys stay equal."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return [(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def _keyed(numbers: list[int]):
    """One row for each vector and pass, with the pass's sort key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d)) if (dims != d).any() else batch
                x, dim = _matrix(part.column(1))
                for p in numbers:
                    bits = np.zeros((len(x), 64), np.uint8)
                    bits[:, 2:] = x @ _planes(dim, p) > 0
                    key = np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part.column(2), pa.array(key), part.column(0), part.column(1)], ["pass", "dim", "key", "id", "v"])

    return run


def _windowed(window: int, least: float):
    """Forest links of the pairs that lie within ``window`` places of each other and reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # pass, dimension, ids and vectors of the last rows
        for batch in batches:
            p, d, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for i, j in _runs(p, d):
                x, own = _matrix(batch.column(3).slice(i, j - i))[0], ids[i:j]
                before = 0
                if kept and kept[:2] == (p[i], d[i]):
                    before = len(kept[2])
                    own, x = np.concatenate([kept[2], own]), np.concatenate([kept[3], x])
                a, b = [], []
                for lo in range(max(0, before - window), len(x), ROWS):
                    one, two = np.nonzero(x[lo : lo + ROWS] @ x[lo : lo + ROWS + window].T >= least)
                    new = (two > one) & (two - one <= window) & (two + lo >= before)
                    a.append(own[one[new] + lo])
                    b.append(own[two[new] + lo])
                kept = (p[i], d[i], own[-window:], x[-window:])
                if a and sum(map(len, a)):
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield from _forest([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])])

    return run


def _degrees(least: float):
    """Links of each vector inside a group of one or two blocks of a component, weighted by copies."""
    far = math.acos(least)

    def solved(lo: int, hi: int, ids, chunk, weight, x) -> pa.RecordBatch:
        a, b = chunk == lo, chunk == hi
        xa, xb, wa, wb = x[a], x[b], weight[a], weight[b]
        ca, cb = xa.sum(0), xb.sum(0)
        ca, cb = ca / max(np.linalg.norm(ca), 1e-12), cb / max(np.linalg.norm(cb), 1e-12)
        ra, rb = (np.arccos(np.clip((y @ c).min(), -1, 1)) for y, c in ((xa, ca), (xb, cb)))
        apart = np.arccos(np.clip(ca @ cb, -1, 1))
        if apart + ra + rb < far - 1e-9:
            da, db = np.full(len(xa), wb.sum()), np.full(len(xb), wa.sum())
        elif apart - ra - rb > far + 1e-9:
            da, db = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
        else:
            hit = xa @ xb.T >= least
            da, db = hit @ wb, wa @ hit
        if lo == hi:
            if apart + ra + rb >= far - 1e-9:
                da = da - np.diagonal(hit) * wa
            else:
                da = da - wa
            out = [(ids[a], da)]
        else:
            out = [(ids[a], da), (ids[b], db)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64))], ["id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield solved(key[1], key[2], *(np.concatenate([h[q] for h in held]) for q in range(4)))

        for batch in batches:
            c, lo, hi, chunk, ids, w, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            for i, j in _runs(c, lo, hi):
                now = (c[i], lo[i], hi[i])
                if now != key:
                    yield from close()
                    held, key = [], now
                held.append((ids[i:j], chunk[i:j], w[i:j], _matrix(batch.column(7).slice(i, j - i))[0]))
        yield from close()

    return run


def _missed(queries: list[tuple], least: float):
    """Links of the query set in each batch: how many, how many inside components, and a link to each component missed."""
    by_dim: dict[int, tuple] = {}
    for d in {q[1] for q in queries}:
        own = [q for q in queries if q[1] == d]
        by_dim[d] = np.array([q[0] for q in own], np.int64), np.array([q[2] for q in own], np.int64), _matrix(pa.array([q[3] for q in own]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                if d not in by_dim:
                    continue
                part = batch.filter(pa.array(dims == d)) if (dims != d).any() else batch
                ids, member = part.column(0).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                q, group, y = by_dim[int(d)]
                i, j = np.nonzero(y @ _matrix(part.column(1))[0].T >= least)
                other = q[i] != ids[j]
                i, j = i[other], j[other]
                apart = group[i] != member[j]
                _, one = np.unique(np.stack([i[apart], member[j[apart]]]), axis=1, return_index=True) if apart.any() else (None, np.zeros(0, np.int64))
                n = np.bincount(i, minlength=len(q))
                joined = n - np.bincount(i[apart], minlength=len(q))
                some = np.flatnonzero(n)
                a = np.concatenate([q[some], q[i[apart][one]]])
                b = np.concatenate([q[some], ids[j[apart][one]]])
                zero = np.zeros(len(one), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([n[some], zero]).astype(np.int64)), pa.array(np.concatenate([joined[some], zero]).astype(np.int64))], ["a", "b", "links", "joined"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the vectors in batches sorted by component and projection: a row (kind 0) a vector, then one (1) a block and one (2) a run of blocks.

    ``run`` and ``block`` are names; centre, radius and weight describe a block or run.
    """
    from pyspark import TaskContext

    base, blocks, runs = TaskContext.get().partitionId() << 32, 0, 0
    held: list[tuple] = []  # parts of the block: ids, weights, vectors as they came
    done: list[tuple] = []  # blocks of the run: centre, radius, weight
    now = None
    kind = None

    def row(what: int, block: int | None, centre: np.ndarray, radius: float, weight: int) -> pa.RecordBatch:
        none = pa.nulls(1)
        cols = [pa.array([what], pa.int32()), pa.array([now], pa.int64()), pa.array([base + runs]), pa.array([block], pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(kind), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(radius)]), pa.array([int(weight)], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, FIELDS)

    def close_block() -> Iterator[pa.RecordBatch]:
        nonlocal blocks
        if not held:
            return
        ids, w, dim, v = (pa.concat_arrays([h[q] for h in held]) for q in range(4))
        x = _matrix(v)[0]
        centre = x.sum(0)
        centre /= max(np.linalg.norm(centre), 1e-12)
        radius, weight = float(np.arccos(np.clip((x @ centre).min(), -1, 1))), int(w.to_numpy(zero_copy_only=False).sum())
        n = len(ids)
        name = base + blocks
        cols = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, now)), pa.array(np.full(n, base + runs)), pa.array(np.full(n, name)), ids, w, dim, v, pa.nulls(n).cast(pa.list_(pa.float64())), pa.nulls(n).cast(pa.float64()), pa.nulls(n).cast(pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, FIELDS)
        yield row(1, name, centre, radius, weight)
        done.append((centre, radius, weight))
        held.clear()
        blocks += 1

    def close_run() -> Iterator[pa.RecordBatch]:
        nonlocal runs
        yield from close_block()
        if done:
            centre = sum(c * w for c, _, w in done)
            centre = centre / max(np.linalg.norm(centre), 1e-12)
            yield row(2, None, centre, max(float(np.arccos(np.clip(c @ centre, -1, 1))) + r for c, r, _ in done), sum(w for _, _, w in done))
            done.clear()
            runs += 1

    for batch in batches:
        kind = batch.column(4).type
        component = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in _runs(component):
            if component[i] != now:
                yield from close_run()
                now = int(component[i])
            while i < j:
                k = min(j, i + BLOCK - sum(len(h[0]) for h in held))
                held.append(tuple(batch.column(q).slice(i, k - i) for q in range(1, 5)))
                i = k
                if sum(len(h[0]) for h in held) >= BLOCK:
                    yield from close_block()
                    if len(done) >= RUN:
                        yield from close_run()
    if now is not None:
        yield from close_run()


FIELDS = ["kind", "component", "run", "block", "id", "w", "dim", "v", "centre", "radius", "weight"]


def _settled(pairs: DataFrame, name: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Of pairs with centre, radius and weight of sides a and b: what decided ones add to each side, and the others."""
    far = math.acos(least)
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    apart, reach = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))), F.col("radius_a") + F.col("radius_b")
    same = F.col(f"{name}_a") == F.col(f"{name}_b")
    # acos is blunt near 0, by about 1e-8
    pairs = pairs.withColumn("all", F.when(F.when(same, F.lit(0.0)).otherwise(apart) + reach < far - 1e-6, True).when(~same & (apart - reach > far + 1e-6), False))
    both = F.array(F.struct(F.col(f"{name}_a").alias("at"), F.col("weight_b").alias("n"), same.cast("long").alias("own")), F.struct(F.col(f"{name}_b").alias("at"), F.when(same, 0).otherwise(F.col("weight_a")).alias("n"), F.lit(0).cast("long").alias("own")))
    added = pairs.where("all").select(F.explode(both).alias("x")).groupBy(F.col("x.at").alias(name)).agg(F.sum("x.n").alias(f"{name}_n"), F.max("x.own").alias(f"{name}_own"))
    return added, pairs.where("all is null")


def _counted(parts: DataFrame, least: float) -> DataFrame:
    """``id`` and ``n``, its links to others of its component, copies included, for rows (component, key, id, w, dim, v)."""
    kind = parts.schema["v"].dataType.simpleString()
    ordered = parts.repartitionByRange("component", "key", "id").sortWithinPartitions("component", "key", "id").select("component", "id", "w", "dim", "v")
    fields = f"kind int, component bigint, run bigint, block bigint, id bigint, w bigint, dim int, v {kind}, centre array<double>, radius double, weight bigint"
    cut = settle(ordered.mapInArrow(_cut, fields), "blocks")
    runs = cut.where("kind = 2").select("component", "run", "centre", "radius", "weight")
    runs = runs.join(runs.groupBy("component").agg(F.ceil(F.count("*") / RUN).alias("deals")), "component")

    def side(df: DataFrame, names: list[str], x: str) -> DataFrame:
        return df.select(*[F.col(c) for c in df.columns if c not in names], *[F.col(c).alias(f"{c}_{x}") for c in names])

    told = ["run", "centre", "radius", "weight"]
    left = side(runs.withColumn("deal", F.pmod(F.xxhash64("run"), "deals")), told, "a")
    right = side(runs.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1))), told, "b")
    of_runs, open_runs = _settled(left.join(right, ["component", "deal"]).where("run_a <= run_b"), "run", least)
    blocks = cut.where("kind = 1").select("run", "block", "centre", "radius", "weight")
    told = ["run", "block", "centre", "radius", "weight"]
    pairs = open_runs.select("run_a", "run_b").join(side(blocks, told, "a"), "run_a").join(side(blocks, told, "b"), "run_b")
    of_blocks, open_blocks = _settled(pairs.where("run_a < run_b or block_a <= block_b"), "block", least)
    open_blocks = settle(open_blocks.select(F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi")), "open-blocks")
    vectors = cut.where("kind = 0").select("component", "run", "block", "id", "w", "dim", "v")
    ends = open_blocks.withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    near = ends.join(vectors, "block").select("component", "lo", "hi", F.col("block").alias("chunk"), "id", "w", "dim", "v")
    near = near.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "chunk", "id")
    one_by_one = near.mapInArrow(_degrees(least), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    named = vectors.select("run", "block", "id", "w").join(of_runs, "run", "left").join(of_blocks, "block", "left").join(one_by_one, "id", "left")

    def or_zero(c: str):
        return F.coalesce(F.col(c), F.lit(0))

    own = F.when(or_zero("run_own") + or_zero("block_own") > 0, F.col("w")).otherwise(0)
    return settle(named.select("id", (or_zero("run_n") + or_zero("block_n") + or_zero("n") - own).alias("n")), "degrees")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, window: int = 32, recall: float = 0.99) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link at cosine >= ``least`` in double precision. ``n_links`` counts
    the other vectors linked directly, copies included; ``component_id`` is the
    smallest vec_id reachable, the own included, and ``kept`` says whether that
    is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different length.
    Rows that share a vec_id are one node. A row with a null vec_id links with
    nothing, has a null component and is kept. Extra columns are ignored; an
    empty table gives an empty one.

    ``window`` and ``recall`` steer the passes: so many that a pair at the
    threshold meets with probability ``recall`` among evenly spread vectors, then
    twice as many again and again, with windows four times as long up to
    ``WIDEST``, until the links of vectors not asked before, compared with all others, lie
    inside components to that share. Copies of a vector and rows without a sound
    one are kept apart from the join that names the rest.
    """
    v = F.col(embedding)
    kind = vectors.schema[embedding].dataType
    stored = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    sound = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(sound, v.cast(stored)).alias("v"))
    # a vec_id with several vectors is one node: its vectors are named by the smallest id they share with others
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("w"), F.count("*").alias("rows"))
    classes = settle(classes.select(F.xxhash64("v", "first").alias("id"), "first", "v", F.size("v").alias("dim"), "w", "rows"), "classes")
    several = rows.where("v is not null").groupBy("vec_id").agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q").select("vec_id")
    several = settle(rows.join(several, "vec_id").select("vec_id", "v").distinct().join(classes.select("v", "id"), "v").select("vec_id", "id"), "several")
    same = several.join(several.groupBy("vec_id").agg(F.min("id").alias("b")), "vec_id").select(F.col("id").alias("a"), "b")
    n, done, total, found, repairs = classes.count(), 0, 0, same, []
    for turn in itertools.count():
        total, places = max(2 * total, passes_for(n, window, least, recall)), min(window * 4**turn, max(window, WIDEST))
        for at in range(done, total, AT_ONCE):
            keyed = classes.select("id", "v", "dim").mapInArrow(_keyed(list(range(at, min(total, at + AT_ONCE)))), f"pass int, dim int, key bigint, id bigint, v {stored}")
            # the id splits equal keys, so a large group of near copies spreads over partitions
            ordered = keyed.repartitionByRange("pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
            found = found.union(settle(ordered.select("pass", "dim", "id", "v").mapInArrow(_windowed(places, least), "a bigint, b bigint").distinct(), "pairs"))
        done = total
        member = components(found).withColumnRenamed("node", "id")
        grouped = classes.join(member, "id", "left").select("id", "v", "dim", F.coalesce("component", "id").alias("component"))
        u = F.pmod(F.xxhash64("id", F.lit(f"queries {turn}")), F.lit(1 << 30))
        asked = grouped.where(u < max(1, ((QUERIES << min(turn, 3)) << 30) // max(n, 1)))
        asked = [(r["id"], r["dim"], r["component"], r["v"]) for r in asked.collect()]  # a set of stated size
        told = settle(grouped.mapInArrow(_missed(asked, least), "a bigint, b bigint, links bigint, joined bigint"), "missed")
        links, joined = told.agg(F.sum("links"), F.sum("joined")).first()
        repairs.append(told)
        if (joined or 0) >= recall * (links or 0):
            break
    if turn or links != joined:
        for told in repairs:
            found = found.union(told.where("a <> b").select("a", "b"))
        member = components(found).withColumnRenamed("node", "id")
    groups = settle(member.join(classes, "id"), "members")
    keyed = groups.select("id", "v", "dim").mapInArrow(_keyed([0]), f"pass int, dim int, key bigint, id bigint, v {stored}").select("id", "key")
    degree = _counted(groups.join(keyed, "id").select("component", "key", "id", "w", "dim", "v"), least)
    named = classes.join(degree, "id", "left").join(groups.select("id", "component"), "id", "left").select("v", "w", "rows", "n", F.coalesce("component", "id").alias("component"), "first")
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("rows_of_key"))
    named = spread_join(named, least_id, "component", n).select("v", "w", F.col("rows").alias("rows_of_key"), "n", "component_id")
    named = settle(named, "named")
    sound = spread_join(rows.where("v is not null"), named, "v", named.agg(F.sum("rows_of_key")).first()[0] or 0)
    out = rows.where("v is null").unionByName(sound.drop("rows_of_key"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
