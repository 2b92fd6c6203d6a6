"""Records that hold many small rows as two byte columns, dealt and gathered by a block number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RECORD = "kind int, block bigint, first binary, second binary"


def pack(kind: int, block: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [c[order] for c in columns]
    edges = np.append(0, np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))) if len(block) else np.zeros(1, np.int64)
    for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield (kind, int(block[b]), *[c[b:e].tobytes() for c in columns])


def records(rows: list[tuple]) -> pa.RecordBatch:
    kinds, blocks, first, second = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(blocks, pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary())],
        ["kind", "block", "first", "second"],
    )


def by_block(frame: DataFrame, blocks: int, fn) -> DataFrame:
    """All records of a (kind, block) together: `fn(kind, block, first, second)` yields records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        first, second = [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for kind, block, a, b in zip(*columns, strict=True):
                if held != (kind, block) and held is not None:
                    yield records(list(fn(*held, b"".join(first), b"".join(second))))
                    first, second = [], []
                held = (kind, block)
                first.append(a)
                second.append(b)
        if held is not None:
            yield records(list(fn(*held, b"".join(first), b"".join(second))))

    return frame.repartition(blocks, "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(run, RECORD)
