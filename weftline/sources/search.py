"""Search services as table functions: a row of queries in, rows of results out.

A transport is a callable that takes a query and the number of results wanted and
returns the service's answer as a dictionary; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, int], dict]
# The services by name, and the results that are asked of one. A service without a transport gives no results.
SERVICES = ("tavily", "langsearch", "brave", "serper")
RESULTS = 5
COLUMNS = ("pos", "url", "title", "snippet", "summary", "error")


def searched(queries: DataFrame, transports: dict[str, Transport], query: str = "query", service: str = "service", most: int = RESULTS, width: int | None = None, errors: bool = False) -> DataFrame:
    """The results of each row's query: its columns, ``pos`` from 0, ``url``, ``title``, ``snippet`` and ``summary``.

    A query that fails is skipped, as are rows whose service is unknown, null or
    without a transport; with ``errors`` a failed query gives one row that has
    only ``error``. Results keep the service's order, are not made distinct, and
    lack nothing: missing fields are empty. A null query is empty; repeated rows
    are asked for each. ``width`` bounds the number of calls at a time. Columns
    with the names of the results' are replaced.
    """
    base = queries.drop(*COLUMNS)
    schema = base.withColumns({c: F.lit(None).cast("int" if c == "pos" else "string") for c in COLUMNS}).schema
    known = {k: v for k, v in transports.items() if k in SERVICES}

    def ask(q: str | None, transport: Transport) -> list[tuple]:
        try:
            found = (transport(q or "", most) or {}).get("results") or []
            rows = [(i, r.get("url") or "", r.get("title") or "", r.get("content") or "") for i, r in enumerate(found[:most])]
            return [(*r, r[3], None) for r in rows]
        except Exception as e:  # one bad query must not end the search
            return [(None, None, None, None, None, str(e))] if errors else []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            hits = [(i, *r) for i, (q, s) in enumerate(zip(part[query], part[service], strict=True)) for r in ask(q, known[s])]
            own = part.iloc[[h[0] for h in hits]].reset_index(drop=True)
            more = pd.DataFrame([h[1:] for h in hits], columns=COLUMNS).astype({"pos": "Int32"})
            yield pd.concat([own, more], axis=1)

    asked = base.where(F.col(service).isin(*known)) if known else base.limit(0)
    out = (asked.repartition(width) if width else asked).mapInPandas(run, schema)
    return out if errors else out.drop("error")
