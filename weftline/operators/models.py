"""External model calls as table functions, with an injected callable.

The callable takes a prompt and returns a text; nothing here opens a connection.
Calls run in partitions (their number bounds concurrency), a failed call gives
the fallback, and usage comes back as columns instead of side effects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import with_values
from . import agents as A

#: Characters that count as one token where a model reports no usage.
PER_TOKEN = 4


def stub(prompt: str) -> str:
    """A deterministic offline model: a JSON digest of the prompt's words."""
    words = prompt.split()
    return f'```json\n{{"summary": "{len(words)} words", "confidence": "high"}}\n```'


def answered(rows: DataFrame, prompt: str, model: Callable[[str], str] = stub, width: int | None = None) -> DataFrame:
    """``rows`` with ``reply`` (null if the call failed), ``failed``, and the tokens of both sides.

    ``width`` (1 to 4 by default clamping of callers) is the number of calls at
    a time; without it the rows' own partitions are used. Order columns of
    ``rows`` pass through, so results can be put back in order.
    """
    schema = rows.withColumns({"reply": F.lit(None).cast("string"), "failed": F.lit(False), "prompt_tokens": F.lit(0).cast("bigint"), "completion_tokens": F.lit(0).cast("bigint")}).schema

    def values(own: dict[str, list]) -> dict[str, list]:
        replies, failed = [], []
        for p in own[prompt]:
            try:
                replies.append(model(p or ""))
                failed.append(False)
            except Exception:  # one bad call must not end the run
                replies.append(None)
                failed.append(True)
        return {"reply": replies, "failed": failed, "prompt_tokens": [len(p or "") // PER_TOKEN for p in own[prompt]], "completion_tokens": [len(r or "") // PER_TOKEN for r in replies]}

    return with_values(rows.repartition(width) if width else rows, values, schema, [prompt])


def digested(answers: DataFrame, fallback: str) -> DataFrame:
    """``summary`` and ``confidence`` of each reply's JSON, or ``fallback`` and ``medium`` where there is none."""
    j = T.json_text(T.block_text(F.col("reply")))
    own = answers.withColumn("__j", j)
    return own.withColumns({"summary": T.first_of(F.get_json_object("__j", "$.summary"), F.substring(fallback, 1, 700)), "confidence": T.first_of(F.get_json_object("__j", "$.confidence"), F.lit("medium"))}).drop("__j")


def rows_of(answers: DataFrame, keep: list[str]) -> DataFrame:
    """The rows that replies list under ``rows``, one JSON text each, in order."""
    j = T.json_text(T.block_text(F.col("reply")))
    items = F.from_json(F.get_json_object(j, "$.rows"), "array<string>")
    return answers.select(*keep, F.posexplode(items).alias("pos", "row"))


# --- retries ---------------------------------------------------------------

#: What a request says where a service has no JSON mode; a fixed value.
JSON_HINT = "\n\nReturn only a valid JSON object."


@dataclass(frozen=True)
class Rung:
    """One way to ask: with or without images, JSON mode and hint. ``go_on`` are the parts of an error after which the next rung is tried."""

    name: str
    images: bool = True
    json_mode: bool = True
    hint: bool = False
    go_on: tuple[str, ...] = ()


#: The ways that a service is asked in, in order. A rung that drops images is left out where there are none, as it asks the same again.
LADDERS = {
    "image_fallback": (Rung("vision", go_on=A.IMAGE_ERRORS), Rung("text", images=False)),
    "compatible": (
        Rung("json-mode", go_on=A.COMPATIBILITY_ERRORS),
        Rung("prompt-json", json_mode=False, hint=True, go_on=A.COMPATIBILITY_ERRORS),
        Rung("text-only-json", images=False, json_mode=False, hint=True),
    ),
    "single": (Rung("call"),),
}


def laddered(rows: DataFrame, call: Callable[[str, list[str], bool], str], folder: str, service: str = "service", prompt: str = "prompt", images: str = "images") -> DataFrame:
    """``rows`` with ``reply`` (null if all tries failed), ``rung`` (the last one tried), ``attempts``, ``error`` (the last one's) and the tokens of all tries.

    A round asks what is still open: rows that the round before left unanswered
    with an error that allows another try. ``call`` takes the prompt, the images and whether
    JSON mode is on. Each round is written to ``folder``, which all executors
    share, so no answered call is made again for a later round or a lost
    executor's sake. A null prompt is empty, null images are none, an unknown service has the
    ladder ``single``; repeated rows are asked for each; the columns named above are replaced.
    """
    known = F.coalesce(F.when(F.col(service).isin(*LADDERS), F.col(service)), F.lit("single"))
    own = ["reply", "rung", "attempts", "error", "prompt_tokens", "completion_tokens"]
    start = rows.drop(*own).withColumns({"__service": known, "__images": F.coalesce(F.col(images), F.array().cast("array<string>"))})
    open_rows = start.withColumns({"attempts": F.lit(0), "prompt_tokens": F.lit(0).cast("bigint")})
    spark, done = rows.sparkSession, []
    keep = [c for c in rows.columns if c not in own]

    def ask(own: dict[str, list]) -> dict[str, list]:
        replies, errors = [], []
        for p, pictures, mode in zip(own["__prompt"], own["__sent"], own["__json"], strict=True):
            try:
                replies.append(call(p, pictures, bool(mode)))
                errors.append(None)
            except Exception as e:  # it decides the next rung
                replies.append(None)
                errors.append(str(e))
        return {"reply": replies, "error": errors}

    for turn in range(max(map(len, LADDERS.values()))):
        def of(value: Callable[[Rung], object], turn: int = turn):
            out = F.lit(None)
            for name, ladder in LADDERS.items():
                if turn < len(ladder):
                    out = F.when(F.col("__service") == name, F.lit(value(ladder[turn]))).otherwise(out)
            return out

        request = open_rows.withColumns({"rung": of(lambda r: r.name), "__json": of(lambda r: r.json_mode), "__prompt": F.concat(T.or_empty(F.col(prompt)), F.when(of(lambda r: r.hint), F.lit(JSON_HINT)).otherwise(F.lit(""))), "__sent": F.when(of(lambda r: r.images), F.col("__images")).otherwise(F.array().cast("array<string>"))})
        request = request.withColumns({"attempts": F.col("attempts") + 1, "prompt_tokens": F.col("prompt_tokens") + F.floor(F.char_length("__prompt") / PER_TOKEN)})
        schema = request.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema
        at = f"{folder}/calls-{uuid.uuid4().hex}"
        with_values(request, ask, schema, ["__prompt", "__sent", "__json"]).write.parquet(at)
        tried = spark.read.schema(schema).parquet(at)
        further = F.lit(False)
        for name, ladder in LADDERS.items():
            if turn + 1 < len(ladder):
                asks_anew = (F.size("__images") > 0) if ladder[turn].images and not ladder[turn + 1].images else F.lit(True)
                further |= (F.col("__service") == name) & asks_anew & A.says_any(F.col("error"), ladder[turn].go_on)
        going_on = F.col("reply").isNull() & further
        done.append(tried.where(~going_on).select(*keep, *own[:5], F.coalesce(F.floor(F.char_length("reply") / PER_TOKEN), F.lit(0)).alias("completion_tokens")))
        open_rows = tried.where(going_on).drop("rung", "__json", "__prompt", "__sent", "reply", "error")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
