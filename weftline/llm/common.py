"""What the text operators share: shared storage, batch slicing and hash folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A session of one machine that names none, as in tests, takes a folder beside
    the warehouse; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate-{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
    return named


#: Shuffle files go as soon as the job that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it.

    Cuts lineage and survives lost executors: the table's files are on storage
    that all of them reach. The shuffle files behind it are freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of settled tables that nothing will read any more."""
    for df in dfs:
        at = getattr(df, "_settled_at", None)
        if at:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Keys that are broadcast at most; more rows than the total divided by this make a key hot.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, least: int = 1000, keep: bool = True) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a ``key`` and in ``rows_of_key`` how many of ``rows`` hold it.

    Rows of a hot key stay where they are: hot keys are those with more than
    ``least`` rows and more than one in ``HOT_KEYS`` of all, so there are
    ``HOT_KEYS`` of them at most, and only they are broadcast. The rest is
    shuffled by the key. ``rows_of_key`` stays in the result, unless ``keep`` is false,
    so that ``rows`` may have a column of that name; ``total`` is the number of rows.
    """
    bound = max(least, total // HOT_KEYS)
    hot, cold = table.where(F.col("rows_of_key") > bound), table.where(F.col("rows_of_key") <= bound)
    if not keep:
        hot, cold = hot.drop("rows_of_key"), cold.drop("rows_of_key")
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def bounded_rows(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` if there are at most ``bound``, else None; never gathers more."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 4 (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4


def held_out(doc_id: str | Column) -> Column:
    return fold(doc_id) == 2


def slices(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array with about ``limit`` bytes at most (one row at least)."""
    off = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the row offsets (a null row is empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) > 1 else np.zeros(0, np.uint8)
    return buf, off - off[0] if len(off) else np.zeros(1, np.int64)
