"""What a session remembers of its run, as state of a stream: hosts, pages, its plan and the step it stands at.

A loop over a session's rows gives the same (tested); what a person typed is kept by
field in an aggregation of its own, as fields have no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.text import or_empty

# Hosts and pages that are remembered.
HOSTS, PAGES = 12, 8
STATE = "hosts array<string>, pages array<string>, plan array<string>, at int, steps bigint"
OUTPUT = "session bigint, steps bigint, hosts array<string>, pages array<string>, plan array<string>, at int"


def moved(plan: list[str], wanted: int) -> tuple[list[str], int]:
    """A plan's states and the step it stands at after progress to step ``wanted``, which is clamped to the plan."""
    at = max(0, min(wanted, len(plan) - 1))
    before = ["done" if s in ("pending", "current") else s for s in plan[:at]]
    return [*before, "current", *("pending" if s == "current" else s for s in plan[at + 1 :])], at


def task_memory(steps: DataFrame) -> DataFrame:
    """Per ``session``: steps so far, the last hosts and pages, the plan's states and the step it stands at.

    ``steps`` has ``session``, ``ts``, ``step``, ``host``, ``page``, ``plan`` (an array of
    states, see ``agents.plan_states``) and ``wanted``. A host that is remembered isn't
    refreshed by another visit, but one that was forgotten comes back; pages may repeat.
    A row with a plan replaces the one before and its ``wanted`` is left out; an empty
    plan is none. Nulls and empty texts are no host, page or progress; progress without
    a plan is lost. Rows must reach a session in order across batches and are sorted by
    ``ts``, then ``step``, within one. State has the same bounds whatever a session's length,
    but for the plan's own; a batch's rows of a session are sorted in one task, so bound
    batches by files.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hosts, pages, plan, at, n = state.get if state.exists else ([], [], [], 0, 0)
        hosts, pages, plan = list(hosts), list(pages), list(plan)
        own = pd.concat(list(parts)).sort_values(["ts", "step"])
        for host, page, new, wanted in own[["host", "page", "plan", "wanted"]].itertuples(index=False):
            if host and host not in hosts:
                hosts = [*hosts, host][-HOSTS:]
            if page:
                pages = [*pages, page][-PAGES:]
            if new is not None and len(new):
                plan, at = list(new), 0
            elif plan and not pd.isna(wanted):
                plan, at = moved(plan, int(wanted))
        n += len(own)
        state.update((hosts, pages, plan, at, n))
        yield pd.DataFrame({"session": [key[0]], "steps": [n], "hosts": [hosts], "pages": [pages], "plan": [plan], "at": [at]})

    needed = steps.select("session", "ts", "step", or_empty(F.col("host")).alias("host"), or_empty(F.col("page")).alias("page"), "plan", F.col("wanted").cast("double").alias("wanted"))
    return needed.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


def typed_fields(steps: DataFrame) -> DataFrame:
    """The last ``value`` typed into each ``field`` of a session, by ``ts``, then ``step``; ``typed_at`` and ``typed_in`` say when and by which step.

    Fields are trimmed, and rows with a null or empty one left out; a null value is empty.
    """
    own = steps.withColumn("field", F.trim(or_empty(F.col("field")))).where("field <> ''")
    last = F.max(F.struct("ts", "step", or_empty(F.col("value")).alias("value"))).alias("l")
    return own.groupBy("session", "field").agg(last).select("session", "field", "l.value", F.col("l.ts").alias("typed_at"), F.col("l.step").alias("typed_in"))
