"""Pause and resume: steps that need an approval wait for it, in order, with what comes after them.

A session runs until a guarded step; that one and all later ones are held until
the session's next decision. Approved, they leave in order; cancelled, they are
dropped. A decision later than ``patience`` after the guarded step is none:
what is held, and what comes before that decision, has expired. A decision
with nothing held changes nothing. The rows don't depend on how the stream is cut
into batches, as long as a session's rows come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session bigint, step bigint, status string, at_ms bigint"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


class Gate(StatefulProcessor):
    """A session's pause: since when (ms), whether that has expired, and the steps held, in their order."""

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pause = handle.getValueState("pause", "since bigint, expired boolean")
        self.held = handle.getListState("held", "step bigint, ms bigint")

    def leave(self, session: int, stored: bool, new: list[tuple], status: str, at: int) -> Iterator[Row]:
        """The steps held from before, if any are stored, and the new ones."""
        for step, ms in [*(self.held.get() if stored else ()), *new]:
            yield Row(session=session, step=step, status=status, at_ms=max(ms, at))
        if stored:
            self.held.clear()

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        # what starts and ends within the rows never reaches the state: each call of the state or a timer takes a round trip
        session, before, new = key[0], self.pause.get(), []
        pause, stored = before, before is not None
        for r in sorted(rows, key=lambda r: (r.ms, r.step)):
            due = None if pause is None else pause[0] + self.patience
            if r.decision is not None:
                if pause is None:
                    continue
                late = pause[1] or r.ms > due
                yield from self.leave(session, stored, new, "expired" if late else "approved" if r.decision == "approve_once" else "cancelled", due if late else r.ms)
                pause, stored, new = None, False, []
            elif pause is None and not r.guarded:
                yield Row(session=session, step=r.step, status="run", at_ms=r.ms)
            elif pause is not None and pause[1]:
                yield Row(session=session, step=r.step, status="expired", at_ms=max(r.ms, due))
            else:
                if pause is None:
                    pause = (r.ms, False)
                new.append((r.step, r.ms))
        if not stored:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.patience)
            if pause is not None:
                self.pause.update(pause)
                self.handle.registerTimer(pause[0] + self.patience)
            elif before is not None:
                self.pause.clear()
        if new:
            self.held.appendList(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        since = self.pause.get()[0]
        yield from self.leave(key[0], True, [], "expired", since + self.patience)
        self.pause.update((since, True))

    def close(self) -> None:
        pass


def gated(steps: DataFrame, decisions: DataFrame, patience: str = "2 days", delay: str = "1 hour") -> DataFrame:
    """What becomes of each step: ``session``, ``step``, ``status`` (run, approved, cancelled, expired) and when it left (``at_ms``).

    ``steps`` are ``session``, ``step``, ``ts`` and ``guarded``, ``decisions`` ``session``, ``step``, ``ts`` and
    ``decision`` (``approve_once`` or anything else); both are streams. Steps that still
    wait at the stream's end give no row. A session's rows of one batch, sorted by time and
    step, are in one task; rows without time or session are left out.
    """
    both = steps.select("session", "step", "ts", F.coalesce("guarded", F.lit(False)).alias("guarded"), F.lit(None).cast("string").alias("decision"))
    both = both.unionByName(decisions.select("session", "step", "ts", F.lit(False).alias("guarded"), F.coalesce("decision", F.lit("cancel")).alias("decision")))
    rows = both.where("session is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    wait = F.expr(f"INTERVAL {patience}")
    patience_ms = steps.sparkSession.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + wait)).first()[0]
    return rows.groupBy("session").transformWithState(Gate(patience_ms), OUTPUT, "append", "EventTime")
