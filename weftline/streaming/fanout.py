"""Steps to the panel and to every tab that takes part: a streaming sink of several targets that writes an epoch once.

Tasks write Parquet files into a staging folder; ``commit`` moves them into the
targets' folders of the epoch and then names the epoch in a log, whose entry decides:
an epoch that is in it is left alone when it comes again, one that isn't is
replaced. ``abort`` deletes what was staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one target that a task holds before it writes a file.
ROWS = 50_000


def fanned_out(steps: DataFrame) -> DataFrame:
    """``target`` and the step, a row for the panel and for each distinct tab; screenshots without image go nowhere.

    ``steps`` has ``type``, ``image``, ``current_tab``, ``agent_tab`` and ``task_tabs``; null tabs are none.
    """
    tabs = F.array_compact(F.array_distinct(F.concat(F.array("current_tab", "agent_tab"), F.coalesce("task_tabs", F.array().cast("array<bigint>")))))
    to = F.concat(F.array(F.lit("panel")), F.transform(tabs, lambda t: F.concat(F.lit("tab-"), t.cast("string"))))
    sent = steps.where((F.coalesce("type", F.lit("")) != "screenshot") | (F.coalesce("image", F.lit("")) != ""))
    return sent.select(F.explode(to).alias("target"), *[c for c in steps.columns if c not in ("current_tab", "agent_tab", "task_tabs")])


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class FanOutWriter(DataSourceStreamWriter):
    def __init__(self, path: str, names: list[str], schema: pa.Schema) -> None:
        self.path, self.names, self.schema = path, names, schema

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, root = self._fs()
        fs.create_dir(f"{root}/_staged", recursive=True)
        held: dict[str, list[tuple]] = {}
        out = Staged()

        def flush(target: str) -> None:
            file = f"{root}/_staged/{uuid.uuid4().hex}.parquet"
            rows = held.pop(target)
            pq.write_table(pa.Table.from_pylist([dict(zip(self.names, r, strict=True)) for r in rows], self.schema), file, filesystem=fs)
            out.files.append((target, file))

        for row in iterator:
            own = held.setdefault(row.target, [])
            own.append(tuple(row))
            if len(own) >= ROWS:
                flush(row.target)
        for target in list(held):
            flush(target)
        return out

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        fs, root = self._fs()
        if fs.get_file_info(f"{root}/_log/{batchId}").type != pafs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        at = f"{root}/epoch={batchId}"
        if fs.get_file_info(at).type != pafs.FileType.NotFound:  # left by a commit that did not end
            fs.delete_dir(at)
        for m in messages:
            for _, file in m.files if m else ():
                fs.create_dir(at, recursive=True)
                fs.move(file, f"{at}/{file.rpartition('/')[2]}")
        fs.create_dir(f"{root}/_log", recursive=True)
        with fs.open_output_stream(f"{root}/_log/{batchId}") as f:
            f.write(b"committed")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        fs, _ = self._fs()
        for m in messages:
            for _, file in m.files if m else ():
                if fs.get_file_info(file).type != pafs.FileType.NotFound:
                    fs.delete_file(file)


class FanOut(DataSource):
    """``writeStream.format("fan_out")`` with the option ``path``, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "fan_out"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FanOutWriter:
        from pyspark.sql.pandas.types import to_arrow_schema

        path = self.options["path"]
        return FanOutWriter(path if ":/" in path else f"file://{path}", schema.names, to_arrow_schema(schema))


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the sink's finished epochs hold."""
    epochs = spark.read.format("binaryFile").load(f"{path}/_log").select(F.regexp_extract("path", r"/(\d+)$", 1).alias("e"))
    done = [r.e for r in epochs.collect()]  # a name an epoch
    found = spark.read.schema(schema).option("basePath", path)
    return found.parquet(*[f"{path}/epoch={e}" for e in done if _exists(spark, f"{path}/epoch={e}")]).select(*schema.names)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
