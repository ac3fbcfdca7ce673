"""Order-dependent state of sessions, in closed form over windows.

Each operator is partitioned by session; a session's log is the unit that must
fit an ordered scan, not memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(session: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*session).orderBy(*order)


def repeats(df: DataFrame, value: Column, session: list[str], order: list[str], out: str = "repeats") -> DataFrame:
    """How often the value has occurred in a row before this row: 0 at a change, then 1, 2 and so on.

    Null and empty values never repeat.
    """
    w = _by(session, order)
    own = df.withColumn("__v", F.nullif(value, F.lit("")))
    own = own.withColumn("__new", F.when(F.col("__v").isNotNull() & F.lag("__v").over(w).eqNullSafe(F.col("__v")), 0).otherwise(1))
    own = own.withColumn("__run", F.sum("__new").over(w))
    run = Window.partitionBy(*session, "__run").orderBy(*order)
    return own.withColumn(out, F.row_number().over(run) - 1).drop("__v", "__new", "__run")


def since_reset(df: DataFrame, counts: Column, resets: Column, session: list[str], order: list[str], out: str = "n") -> DataFrame:
    """Rows that count since the last row that resets; other rows leave the number unchanged."""
    w = _by(session, order)
    own = df.withColumn("__c", F.when(counts, 1).otherwise(0)).withColumn("__run", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*session, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(out, F.sum("__c").over(inside)).drop("__c", "__run")


def last_n(df: DataFrame, value: Column, n: int, session: list[str], order: list[str], out: str = "last") -> DataFrame:
    """The values of this row and the n - 1 before it, oldest first."""
    return df.withColumn(out, F.collect_list(value).over(_by(session, order).rowsBetween(-(n - 1), 0)))


def first_seen_last_n(df: DataFrame, value: Column, n: int, session: list[str], order: list[str]) -> DataFrame:
    """A session's last n distinct values by first occurrence (seeing a value again doesn't refresh it); ``pos`` from 1."""
    own = df.withColumn("value", value).where(F.coalesce("value", F.lit("")) != "")
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy(*session, "value").orderBy(*order))).where("__n = 1")
    late = first.withColumn("__late", F.row_number().over(Window.partitionBy(*session).orderBy(*[F.desc(o) for o in order]))).where(F.col("__late") <= n)
    return late.withColumn("pos", F.row_number().over(_by(session, order))).select(*session, "pos", "value")


def compaction_slice(steps: DataFrame, done: int, kinds: tuple[str, ...], session: list[str], order: list[str], keep: int = 4) -> DataFrame:
    """The steps to summarise next: of the given kinds, after the first ``done``, but the last ``keep``."""
    own = steps.where(F.col("type").isin(*kinds))
    own = own.withColumn("n", F.row_number().over(_by(session, order))).withColumn("left", F.count("*").over(Window.partitionBy(*session)) - F.col("n"))
    return own.where((F.col("n") > done) & (F.col("left") >= keep)).drop("left")


def in_order_once(steps: DataFrame, session: list[str], index: str = "index", arrival: str = "arrival") -> DataFrame:
    """Each step once (the first to arrive), numbered by its index."""
    one = steps.withColumn("__n", F.row_number().over(Window.partitionBy(*session, index).orderBy(arrival))).where("__n = 1").drop("__n")
    return one.withColumn("place", F.row_number().over(_by(session, [index])))
