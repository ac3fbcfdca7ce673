"""Arrow batches in bounded pieces, for functions that work row by row on wide texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes and rows that are worked on at a time; one row at least.
BYTES, ROWS = 1 << 18, 256


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in order, halved until each piece is small enough."""
    if batch.num_rows <= 1 or batch.num_rows <= ROWS and batch.nbytes <= BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))


def map_rows(df: DataFrame, made: Callable[[dict[str, list]], list[dict]], schema: str) -> DataFrame:
    """The rows that ``made`` gives for each piece of ``df``, whose columns it gets as lists; only a piece's rows are in memory."""
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                if rows := made(piece.to_pydict()):
                    yield pa.RecordBatch.from_pylist(rows, to)

    return df.mapInArrow(run, schema)


def with_values(df: DataFrame, values: Callable[[dict[str, list]], dict[str, list]], schema: StructType, read: list[str]) -> DataFrame:
    """``df`` with the columns that ``values`` makes of the columns ``read``, piece by piece; all other columns pass as they are."""
    to = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                new = values(piece.select(read).to_pydict())
                own = dict(zip(piece.schema.names, piece.columns, strict=True)) | {c: pa.array(v, to.field(c).type) for c, v in new.items()}
                yield pa.RecordBatch.from_arrays([own[c] for c in to.names], to.names)

    return df.mapInArrow(run, schema)
