"""Arrow batches small enough for long texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes in a batch sent to Python, however long its texts are.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches where they stand at Spark's default (64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))


def emit(rows: Iterable[tuple], schema: pa.Schema, at_once: int = 4096, characters: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows``, of at most so many rows and characters of text each."""
    held: list[tuple] = []
    length = 0
    for row in rows:
        held.append(row)
        length += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= at_once or length >= characters:
            yield _batch(held, schema)
            held, length = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
