"""Rendering a session's steps again after a restart: each once, from what was rendered before."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "panel bigint, session string, step bigint, place bigint, reset boolean"


class Panel(StatefulProcessor):
    """What a panel shows: its session and the steps rendered in it. Another session empties it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "session string, steps array<bigint>")

    def handleInitialState(self, key, initialState, timers) -> None:
        self.shown.update((initialState.session, list(initialState.steps)))

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        session, steps = self.shown.get() or (None, [])
        order, seen = list(steps), set(steps)
        for r in sorted(rows, key=lambda r: (r.ts, r.step)):
            reset = r.session != session
            if reset:
                session, order, seen = r.session, [], set()
            if r.step in seen:
                continue
            order.append(r.step)
            seen.add(r.step)
            yield Row(panel=key[0], session=session, step=r.step, place=len(order), reset=reset)
        self.shown.update((session, order))

    def close(self) -> None:
        pass


def history_of(rendered: DataFrame) -> DataFrame:
    """The state to start from: each panel's last session and the steps rendered in it (``panel``, ``session``, ``ts``, ``step``)."""
    last = rendered.groupBy("panel").agg(F.max_by("session", F.struct("ts", "step")).alias("session"))
    own = rendered.join(last, ["panel", "session"]).groupBy("panel", "session").agg(F.sort_array(F.collect_set(F.struct("ts", "step"))).alias("s"))
    return own.select("panel", "session", F.col("s.step").alias("steps"))


def rehydrated(steps: DataFrame, history: DataFrame) -> DataFrame:
    """Steps that a panel renders now: those of its running session that it has not shown, and all of later sessions.

    ``steps`` is a stream of ``panel``, ``session``, ``step``, ``ts`` in which what was rendered before comes again;
    ``history`` is what ``history_of`` gives. ``place`` counts on from the history. State is a
    session's steps; it is let go with the session.
    """
    rows = steps.where("panel is not null").select("panel", "session", "step", "ts")
    return rows.groupBy("panel").transformWithState(Panel(), OUTPUT, "append", "None", history.groupBy("panel"))
