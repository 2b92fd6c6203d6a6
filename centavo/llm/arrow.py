"""Helpers for Arrow stages: bounded chunks of texts as one byte buffer."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import centavo.llm

# Tasks get these functions with their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(centavo.llm)

CHUNK_BYTES = 2 << 20
DOCUMENT = "doc_id bigint, text string"


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so extra columns never reach an Arrow stage; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`fn` takes a batch of at most about `chunk_bytes` of its string columns (a longer single row
    comes alone) and yields columns of the output."""
    out = T._parse_datatype_string(schema)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for part in slices(batch, chunk_bytes):
                for columns in fn(part):
                    arrays = [_array(columns[f.name], f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
        give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """Hand freed memory back to the system: a worker that has run other tasks holds on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _array(values, kind) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind) if values.type != kind else values
    return pa.array(values, kind)


def slices(batch: pa.RecordBatch, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.diff(offsets(column))
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > chunk_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column, one more than rows."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column in one buffer, and the offset of each row in it. Nulls must be filled before."""
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def separated(data: np.ndarray, at: np.ndarray, separator: int, before: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rows with `before` separator bytes ahead of each and one after the last; starts of the rows in it."""
    n = len(at) - 1
    out = np.full(len(data) + before * n + 1, separator, np.uint8)
    starts = at[:-1] + before * (np.arange(n) + 1)
    for begin, end, to in zip(at[:-1].tolist(), at[1:].tolist(), starts.tolist(), strict=True):
        out[to : to + end - begin] = data[begin:end]
    return out, starts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
