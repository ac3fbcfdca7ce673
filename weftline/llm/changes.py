"""Sequenced changes applied in order: a ``transformWithState`` stage over batches of a change log.

The stage has a state for each client: it holds rows that come too early, applies
the next number as long as it is there, rejects rows whose number is held or
passed, and skips a gap when the earliest held row has waited ``PATIENCE`` days by
the event-time watermark. Of a batch's rows of one number the first goes to its
client; the others, which can only be rejected, pass the stage in groups of their
own, so a client with many repeats is spread.

Spark asks its state server several times for each key it calls a stage with
(0.8 ms a key, measured), so the stage is called with groups of about
``PER_GROUP`` keys, dealt by hash, whose states are one pickled value. What is
decided is decided by client. Each state partition opens a store and writes files
at each start, so there is one stage and its files have no checksum files.

Rows are numbered by the dense rank of ``seq`` within the client, which
``dense_numbers`` finds over range partitions, no client in one task.

Defined results: rows equal in all columns count once. A null ``client_id`` is a
client, a null ``seq`` the smallest number of its client, a null ``change_id``
hashes as the empty text. Rows without ``valid_at`` vanish. Days before the first batch's
belong to the first batch. Of rows with one number, day and change id the one
with the smallest op, city and cents (nulls first) arrives first. An ``op`` other than I,
U and D changes nothing, but counts as applied. A null or non-finite balance
gives null cents. Empty tables give no rows; further columns make rows distinct
and are not returned.
"""

from __future__ import annotations

import contextlib
import pickle
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .common import discard, settle, shared_dir

BATCHES, FIRST_DAY, DAYS = 8, 19723, 160
#: Days a held row waits for the numbers before it.
PATIENCE = 5
MS = 86_400_000
#: Keys that a call of a stage takes together, about.
PER_GROUP = 1000
#: Held rows of a client are kept in its state up to this many, beyond it in blocks of ``BLOCK`` numbers.
INLINE, BLOCK = 64, 256
#: New rows that a task looks at together, and held rows of a client that it has in memory.
CHUNK = 20_000

APPLIED = "change_id bigint, client_id bigint, n bigint, status string, batch int, missed bigint, city string, cents bigint, op string"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # every start has stores of its own
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


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


def dense_numbers(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The distinct pairs of ``group`` and ``order`` with ``n``, the dense rank of ``order`` within the group (nulls first).

    Pairs are dealt by range, numbered within a partition, and moved on by what
    the partitions before hold of the group; a large group takes many tasks.
    The partition is written with the rows, so a repeated task can't change it.
    """
    pairs = rows.select(group, order).distinct().repartitionByRange(group, order)
    dealt = settle(pairs.withColumn("__part", F.spark_partition_id()), "numbers")
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(w), F.lit(0)).alias("__before"))
    own = Window.partitionBy(group, "__part").orderBy(order)
    numbered = dealt.withColumn("__own", F.row_number().over(own))
    n = numbered.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__p")))
    out = n.select(group, order, (F.col("__own") + F.col("__before")).alias("n"))
    out._settled_at = dealt._settled_at
    return out


def crc_of(c: str) -> Column:
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))


def numbered(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that take part, with ``n``, ``day``, ``batch`` and ``cents``; and the helper table behind it, to be discarded."""
    rows = changes.distinct()
    numbers = dense_numbers(changes, "client_id", "seq")
    other = numbers.select(F.col("client_id").alias("__c"), F.col("seq").alias("__s"), "n")
    h = crc_of("change_id")
    day = (F.unix_date(F.to_date("valid_at")) + F.lit(2) * (h % 4)).cast("int")
    cents = F.when(~F.isnan("balance") & (F.abs("balance") < 9e16), F.floor(F.lit(100.0) * F.col("balance") + 0.5))
    kept = rows.where(F.col("valid_at").isNotNull() & (h % 11 != 0))
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / F.lit(DAYS)))).cast("int")
    joined = kept.join(other, F.col("client_id").eqNullSafe(F.col("__c")) & F.col("seq").eqNullSafe(F.col("__s")))
    own = joined.select("client_id", "n", "change_id", day.alias("day"), "op", "city", cents.cast("bigint").alias("cents"))
    return own.withColumn("batch", batch), numbers


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeat``: whether another row of the client, number and batch arrives before (by day, change id, then the rest, nulls first).

    Rows equal in all of these are first together; the stage takes one of them.
    """
    arrival = F.struct("day", "change_id", "op", "city", "cents")
    first = rows.groupBy(F.col("client_id").alias("__c"), F.col("n").alias("__n"), F.col("batch").alias("__b")).agg(F.min(arrival).alias("__first"))
    both = rows.join(first, F.col("client_id").eqNullSafe(F.col("__c")) & (F.col("n") == F.col("__n")) & (F.col("batch") == F.col("__b")))
    return both.withColumn("repeat", ~arrival.eqNullSafe(F.col("__first"))).drop("__c", "__n", "__b", "__first")


def loaded(value: tuple | None):
    return None if value is None else pickle.loads(value[0])


class Client:
    """A client's next number, its values, and its held rows: an index of blocks (rows, earliest day) and the blocks in memory.

    Few held rows come and go with the client's state; blocks beyond it are
    fetched from ``stored`` when they are needed and written back when there are many.
    """

    def __init__(self, client_id: int, held, state: tuple | None = None) -> None:
        _, self.next, self.city, self.cents, inline, index = state or (client_id, 1, None, None, None, None)
        self.id, self.held = client_id, held
        self.index = {b: (rows, day) for b, rows, day in index or ()}
        self.stored = set(self.index)
        self.open: dict[int, dict[int, tuple]] = {}
        self.dirty: set[int] = set()
        self.hold(inline or ())

    def due(self) -> int | None:
        """When the earliest held row has waited long enough, in ms."""
        return (min(day for _, day in self.index.values()) + PATIENCE) * MS if self.index else None

    def block(self, b: int) -> dict[int, tuple]:
        if b not in self.open:
            if len(self.open) > CHUNK // BLOCK:
                self.write()
            self.open[b] = loaded(self.held.getValue((self.id, b))) if b in self.stored else {}
        return self.open[b]

    def write(self) -> None:
        for b in self.dirty:
            if own := self.open[b]:
                self.held.updateValue((self.id, b), (pickle.dumps(own),))
                self.stored.add(b)
            elif b in self.stored:
                self.held.removeKey((self.id, b))
                self.stored.discard(b)
        self.open.clear()
        self.dirty.clear()

    def changed(self, b: int) -> None:
        self.dirty.add(b)
        if own := self.open[b]:
            self.index[b] = (len(own), min(r[2] for r in own.values()))
        else:
            self.index.pop(b, None)

    def hold(self, rows) -> None:
        blocks: dict[int, list[tuple]] = {}
        for r in rows:
            blocks.setdefault(r[0] // BLOCK, []).append(r)
        for b, own in blocks.items():
            self.block(b).update((r[0], r) for r in own)
            self.changed(b)

    def state(self) -> tuple:
        if self.stored or sum(rows for rows, _ in self.index.values()) > INLINE:
            self.write()
            return self.id, self.next, self.city, self.cents, [], [(b, rows, day) for b, (rows, day) in self.index.items()]
        return self.id, self.next, self.city, self.cents, [r for own in self.open.values() for r in own.values()], []

    def apply(self, r: tuple, missed: int = 0) -> tuple:
        """The row applied: itself, numbers missed before it, city and cents after it."""
        n, _, _, op, city, cents = r
        if op in ("I", "D"):
            self.city, self.cents = (city, cents) if op == "I" else (None, None)
        elif op == "U":
            self.city, self.cents = (self.city if city is None else city), (self.cents if cents is None else cents)
        self.next = n + 1
        return r, missed, self.city, self.cents

    def cascade(self, missed: int = 0) -> Iterator[tuple]:
        """Held rows from the next number on."""
        while (b := self.next // BLOCK) in self.index:
            own, some = self.block(b), False
            while r := own.pop(self.next, None):
                some = True
                yield self.apply(r, missed)
                missed = 0
            if some:
                self.changed(b)
            if self.next // BLOCK == b:
                return

    def skip(self, clock: int) -> Iterator[tuple]:
        """While the earliest held row is due by ``clock`` (ms), jumps to the smallest held number and goes on from there."""
        while self.index and self.due() <= clock:
            to = min(self.block(min(self.index)))
            missed, self.next = to - self.next, to
            yield from self.cascade(missed)

    def repeats(self, rows: dict[int, tuple]) -> list[tuple]:
        """Takes out the rows whose number is held."""
        held = [n for n in sorted(rows) if n // BLOCK in self.index and n in self.block(n // BLOCK)]
        return [rows.pop(n) for n in held]

    def take(self, rows: dict[int, tuple]) -> Iterator[tuple]:
        """What comes next out of new and held rows in turn; the rest of the new ones is held."""
        while True:
            while r := rows.pop(self.next, None):
                yield self.apply(r)
            at = self.next
            yield from self.cascade()
            if self.next == at:
                break
        self.hold(rows.values())


class Sequencer(StatefulProcessor):
    """Holds, applies, rejects and skips, client by client.

    In memory are the states of a group's clients and ``CHUNK`` new rows. Within a
    batch the order of rows doesn't matter: numbers are unique there but for equal
    rows, and the next number jumps at the batch's start only. A timer wakes a group
    when its first held row is due.
    """

    def __init__(self, batch: int, groups: int) -> None:
        self.batch, self.groups = batch, groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getValueState("clients", "states binary")
        self.held = handle.getMapState("held", "client_id bigint, block bigint", "rows binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        if key[0] is None:  # the row that starts a batch
            return
        if key[0] >= self.groups:
            for r in rows:
                yield self.rejected(r.client_id, r.n, r.change_id, r.op)
            return
        yield from self.run(rows, timers.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.run((), timerValues.getCurrentWatermarkInMs())

    def run(self, rows, clock: int) -> Iterator[Row]:
        states = loaded(self.clients.get()) or {}
        own = {k: Client(k, self.held, s) for k, s in states.items() if s[4] or s[5]}
        for c in own.values():
            for x in c.skip(clock):
                yield self.applied(c, x)
        chunk: dict[int, dict[int, tuple]] = {}
        size = 0
        for r in rows:
            if r.client_id not in own:
                own[r.client_id] = Client(r.client_id, self.held, states.get(r.client_id))
            new = chunk.setdefault(r.client_id, {})
            if r.n < own[r.client_id].next or r.n in new:
                yield self.rejected(r.client_id, r.n, r.change_id, r.op)
                continue
            new[r.n] = (r.n, r.change_id, r.day, r.op, r.city, r.cents)
            size += 1
            if size >= CHUNK:
                yield from self.take(own, chunk)
                size = 0
        yield from self.take(own, chunk)
        states |= {k: c.state() for k, c in own.items()}
        self.clients.update((pickle.dumps(states),))
        due = min((d for c in own.values() if (d := c.due()) is not None), default=None)
        before = list(self.handle.listTimers())
        for t in before:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in before:
            self.handle.registerTimer(due)

    def take(self, own: dict[int, Client], chunk: dict[int, dict[int, tuple]]) -> Iterator[Row]:
        for k, new in chunk.items():
            for n, change_id, _, op, _, _ in own[k].repeats(new):
                yield self.rejected(k, n, change_id, op)
            for x in own[k].take(new):
                yield self.applied(own[k], x)
        chunk.clear()

    def applied(self, c: Client, x: tuple) -> Row:
        r, missed, city, cents = x
        return Row(change_id=r[1], client_id=c.id, n=r[0], status="applied", batch=self.batch, missed=missed, city=city, cents=cents, op=r[3])

    def rejected(self, client_id: int | None, n: int, change_id: int | None, op: str | None) -> Row:
        return Row(change_id=change_id, client_id=client_id, n=n, status="rejected", batch=self.batch, missed=0, city=None, cents=None, op=op)

    def close(self) -> None:
        pass


def applied_changes(changes: DataFrame) -> DataFrame:
    """Each change that takes part: ``status``, ``batch``, ``missed``, the client's ``city`` and ``cents`` after it, and ``current``.

    ``changes`` has change_id, client_id, seq, op, valid_at, city and balance. The
    batches, the query's checkpoint and its output lie in a new folder of
    ``spark.checkpoint.dir``.
    """
    spark = changes.sparkSession
    at = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    rows, numbers = numbered(changes)
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), changes.count() // PER_GROUP)
    lane, spread = (F.pmod(F.xxhash64(*by), F.lit(groups)).cast("bigint") for by in (("client_id",), ("change_id", "n")))
    at_day = F.timestamp_seconds(F.col("day").cast("bigint") * 86400)
    rows = with_repeats(rows).withColumns({"at": at_day, "lane": F.when(F.col("repeat"), groups + spread).otherwise(lane)}).drop("repeat")
    # a row without a lane starts a batch that is empty, too; the last one's moves the watermark past all days
    starts = spark.range(1, BATCHES + 2, numPartitions=1).select(F.col("id").cast("int").alias("batch"), F.when(F.col("id") >= BATCHES, F.timestamp_seconds(F.lit(10**11))).alias("at"))
    # a batch is written by a few tasks, in a file each
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES)
    rows = rows.repartition("batch", F.pmod(F.xxhash64("change_id", "n"), F.lit(files)))
    rows.unionByName(starts, allowMissingColumns=True).write.partitionBy("batch").parquet(f"{at}/batches")
    discard(numbers)
    schema = rows.drop("batch").schema
    with settings(spark, ROCKSDB):
        for b in range(1, BATCHES + 2):
            spark.read.schema(schema).parquet(f"{at}/batches/batch={b}").write.mode("append").parquet(f"{at}/fed")
            stream = spark.readStream.schema(schema).parquet(f"{at}/fed").withWatermark("at", "0 seconds")
            done = stream.groupBy("lane").transformWithState(Sequencer(b, groups), APPLIED, "append", "EventTime")
            q = done.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    out = spark.read.schema(done.schema).parquet(f"{at}/rows")
    last = out.where("status = 'applied'").groupBy("client_id").agg(F.max("n").alias("n"))
    last = last.select(F.col("client_id").alias("__c"), F.col("n").alias("__n"), F.lit("applied").alias("__status"))
    both = out.join(last, F.col("client_id").eqNullSafe(F.col("__c")) & (F.col("n") == F.col("__n")) & (F.col("status") == F.col("__status")), "left")
    current = F.col("__n").isNotNull() & ~F.coalesce(F.col("op") == "D", F.lit(False))
    return both.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", current.alias("current"), "n")
