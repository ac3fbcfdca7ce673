"""Step streams of sessions: running state, usage, ordering and checklists.

The batch operators in ``operators.sequences`` give the same rows over a finished
log; the tests hold the two against each other.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.query import StreamingQuery

STATE = "last string, repeats bigint, failures bigint, steps bigint, longest bigint"
OUTPUT = "user_id bigint, steps bigint, longest bigint, repeats bigint, failures bigint"


def read_steps(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream of step files: a folder, a file, or a pattern of either."""
    if path[-1] not in "]*}":  # a pattern lets a single file be a source, too
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def session_state(steps: DataFrame) -> DataFrame:
    """Per session (``user_id``): steps so far, repeats of the last type, longest run, failures in a row.

    Steps (``ts``, ``event_id``, ``event_type``) must reach a session in order
    across batches; within one they are sorted here. State is five values a session.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, repeats, failures, n, longest = state.get if state.exists else (None, 0, 0, 0, 0)
        own = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        # a run ends where the type changes; the first goes on with the state's run
        kinds = own.event_type.reset_index(drop=True)
        start = kinds.ne(kinds.shift())
        run = kinds.groupby(start.cumsum()).cumcount() + ((repeats + 1) if last is not None and kinds[0] == last else 0) * (start.cumsum() == 1)
        wrong = kinds.eq("error")
        since = int((~wrong[::-1]).to_numpy().argmax()) if not wrong.all() else len(kinds)
        failures = since + (failures if since == len(kinds) else 0)
        last, repeats, n, longest = kinds.iloc[-1], int(run.iloc[-1]), n + len(kinds), max(longest, int(run.max()))
        state.update((last, repeats, failures, n, longest))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [n], "longest": [longest], "repeats": [repeats], "failures": [failures]})

    return steps.groupBy("user_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


def running_usage(usage: DataFrame) -> DataFrame:
    """Tokens by model so far; meant for the update output mode."""
    return usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def steps_once(steps: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each step of a session once; a watermark bounds what is remembered."""
    steps = steps.withColumn(time, F.col(time).cast("timestamp"))
    return steps.withWatermark(time, delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def items_once(items: DataFrame) -> DataFrame:
    """Each checklist item once a session (``user_id``, ``item``)."""
    return items.dropDuplicates(["user_id", "item"])


def upsert_to(path: str, keys: list[str]):
    """A ``foreachBatch`` sink that keeps the latest row of each key as Parquet versions under ``path``."""
    from pyspark.sql import Window

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("__epoch", F.lit(epoch))
        if epoch > 0:
            own = own.unionByName(spark.read.parquet(f"{path}/v{epoch - 1}"))
        w = Window.partitionBy(*keys).orderBy(F.desc("__epoch"))
        own.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; a session of one machine without that setting, as in tests, takes its warehouse."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    return f"{named}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, name: str, mode: str) -> tuple[StreamingQuery, DataFrame]:
    """Runs a stream over all that is available into Parquet files in the shared folder; an epoch that is repeated replaces its files."""
    spark = stream.sparkSession
    at = shared_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/epoch={epoch}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows/epoch=-1")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, spark.read.schema(stream.schema).parquet(f"{at}/rows").select(*stream.columns)


def latest(out: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order`` (updates repeat a key)."""
    return out.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in out.columns if c not in keys])
