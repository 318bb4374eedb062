"""What the operators share: reading a table, spreading rows, SHA-256 as text, workers that keep no memory."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Bytes of text that a task turns into arrays at once, unless one text is longer.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which the column comes to a worker."""
    return to_arrow_type(df.schema[column].dataType)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``CHUNK_BYTES`` of text, one row at least."""
    for batch in batches:
        sizes = [len(v) if v is not None else 0 for v in _buffers(batch.column(text))]
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > CHUNK_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def give_back() -> None:
    """Hand memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the GNU library only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` in a worker that gives back what it no longer needs at the end of the task. Workers live on for later stages, and
    would hold the memory of their largest task beside the executor's own."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def _buffers(column: pa.Array) -> Iterator[memoryview | None]:
    for value in column:
        yield value.as_buffer() if value.is_valid else None


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


class Remembered(dict):
    """The values of a function for the arguments met last: two generations of ``size`` each, so memory is bounded."""

    def __init__(self, function: Callable, size: int) -> None:
        super().__init__()
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}
