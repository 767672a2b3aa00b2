"""Shared by the operators: reading tables, tables written between jobs, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetshape.session import scratch_path

#: Text bytes that one pass of a Python helper holds at a time; a longer document is a pass of its own.
SLICE_BYTES = 4 << 20
#: Rows of one Arrow batch, so that batches of long documents stay small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: documents differ in length by five orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0]:ends[-1]], ends - ends[0]


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces of at most SLICE_BYTES of text (one row at least), with bytes and offsets.

    The text is the last column; what stands before it rides along.
    """
    for batch in batches:
        data, ends = raw_text(batch.column(batch.num_columns - 1))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), data[ends[start]:ends[stop]], ends[start:stop + 1] - ends[start]
            start = stop


def rows_of(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The rows of `raw_text` as byte strings."""
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def counts_in(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes (or words) each row holds."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


def widened(part: pa.RecordBatch, new: dict[str, pa.Array], keep_text: bool = False) -> pa.RecordBatch:
    """The batch with its text replaced by `new` columns, or followed by them."""
    n = part.num_columns - (not keep_text)
    return pa.RecordBatch.from_arrays([*part.columns[:n], *new.values()], names=[*part.schema.names[:n], *new])


def map_text(df: DataFrame, fn, keys: dict[str, Column], text: str, new: str) -> DataFrame:
    """`fn` over Arrow batches of the `keys` columns and the text; it returns `keys` and the columns `new` (DDL), which may begin with the text."""
    small_batches(df.sparkSession)
    slim = df.select(*[c.alias(k) for k, c in keys.items()], df[text].alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]]
    return slim.mapInArrow(fn, ", ".join([*kinds, new]))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that further columns of any name ride along."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])
