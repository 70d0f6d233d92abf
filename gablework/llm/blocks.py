"""Blocks of documents: rows that hold some megabytes of text each, with a dictionary of their own.

What a corpus-wide table has for an entry of a dictionary is looked up once per block and entry, not once per
occurrence. So an entry that stands in every document is as many rows as there are blocks, and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut or joined to about ``most_bytes`` of text; a longer document is a slice of its own."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = np.diff(offsets(batch.column("text")))
        start = 0
        for i, length in enumerate(lengths.tolist()):
            if (size or rows) and (size + length > most_bytes or rows == most_rows):
                yield joined([*held, batch.slice(start, i - start)])
                held, size, rows, start = [], 0, 0, i
            size += length
            rows += 1
        held.append(batch.slice(start))
    if rows:
        yield joined(held)


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    found = np.frombuffer(texts.buffers()[1], dtype=kind) if len(texts) else np.zeros(1, dtype=kind)
    return found[texts.offset : texts.offset + len(texts) + 1]


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def block_number(counter: int) -> int:
    """A number that no other block of the table has: the task's partition and a counter in it."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) + counter


def one_row(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    """A batch of one row; lists become list columns."""

    def column(value, kind: pa.DataType) -> pa.Array:
        if isinstance(value, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
        return pa.array([value], type=kind)

    return pa.RecordBatch.from_arrays([column(values.get(f.name), f.type) for f in schema], schema=schema)


def looked_up(blocks: DataFrame, keys: str, table: DataFrame, columns: list[str]) -> DataFrame:
    """The blocks with ``found``, an array of (pos, *columns) for the keys that the table has, in any order, and with
    ``asked``, the number of their keys, in place of these.

    ``table`` has one row per ``key``, so its partitions are even and small enough to be hashed instead of sorted.
    Each block asks once for each of its distinct keys.
    """
    asked = blocks.select("block", F.posexplode(keys).alias("pos", "key"))
    answers = asked.join(table.hint("shuffle_hash"), "key").groupBy("block").agg(F.collect_list(F.struct("pos", *columns)).alias("found"))
    return blocks.withColumn("asked", F.size(keys)).drop(keys).join(answers, "block", "left")


def answers(row: dict, column: str, dtype: type) -> np.ndarray:
    """The values of one looked-up column by position; 0 where the table has no such key."""
    out, found = np.zeros(max(row["asked"].as_py(), 0), dtype=dtype), row["found"]
    if found.is_valid and len(found.values):
        pos = found.values.field("pos").to_numpy(zero_copy_only=False)
        out[pos] = found.values.field(column).to_numpy(zero_copy_only=False)
    return out


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def compressed(values: np.ndarray) -> bytes:
    """Smaller than what Spark's own compression makes of numbers in a shuffle; the element count comes first."""
    raw = binary(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def numbers(value: pa.BinaryScalar, dtype: type) -> np.ndarray:
    """What ``compressed`` was given."""
    raw = value.as_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd"), dtype=dtype) if size else np.zeros(0, dtype=dtype)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each row as a dictionary of scalars."""
    for batch in batches:
        for i in range(len(batch)):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
