"""Connected components of a link table, for graphs of any size.

Alternating large-star and small-star passes (Kiveris et al., 2014) over a table
of links. The result of each pass is written to the
shared folder, so lineage stays short and a lost executor costs one pass at most.
Links never reach the driver; a forest pass inside each partition first reduces
dense groups to spanning trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, spread_join


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning-forest links (node to root) of the links in each batch."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(a):
            continue
        names, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ids[: len(a)], ids[len(a) :]
        root = np.arange(len(names))
        while True:  # hook the larger root to the smaller one, then jump to the roots
            rx, ry = root[x], root[y]
            lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
            if (lo == hi).all():
                break
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], ["a", "b"])


def _stars(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (a, b) with ``m``, the least b of each a; a hub's rows are not gathered in one task."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows_of_key"))
    return spread_join(rows, least, "a", total).select("a", "b", "m", "rows_of_key")


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 40) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that a link to another names.

    ``links`` has two bigint columns; direction, repeats, self-links and rows
    with nulls don't matter. Nodes without a link to another node get no row; an
    empty table gives an empty one. Raises after ``most`` rounds (a round at
    least halves the longest path, so that means over 10^12 nodes).
    """
    pair = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    now = settle(pair.mapInArrow(_forest, "a bigint, b bigint"), "links")
    seen, size = None, now.count()
    for _ in range(most):
        # large star: every larger neighbour of a node links to the node's smallest neighbour (or itself)
        sides = now.union(now.select("b", "a"))
        large = _stars(sides, 2 * size).where("b > a").select(F.col("b").alias("x"), F.least("m", "a").alias("y")).where("x <> y").distinct()
        # small star: smaller neighbours of a node, and itself, link to the smallest one
        down = settle(large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "large")
        stars = _stars(down, down.count())
        ends = F.explode(F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("b")))
        after = settle(stars.select(ends.alias("x"), "m").select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        size, total = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now, down)
        now = after
        if (size, total) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = (size, total)
    raise RuntimeError(f"components did not settle in {most} rounds")
