"""Sums of numpy vectors over the partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 32
GATHERED = 1 << 20  # numbers that the driver takes of one pass's partial sums; more are summed on the executors first
CHUNK = 1 << 18     # rows of a chunk


def cells(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The matrix of an array column, a missing number as NaN."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column as doubles, a missing number as NaN."""
    return batch.column(column).to_numpy(zero_copy_only=False).astype(float)


def chunked(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches joined to chunks of about ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


PACK = 1 << 16  # rows of a block


def packed(df: DataFrame) -> DataFrame:
    """(x): all columns as doubles, blocks of rows by blocks as the bytes of a matrix, so that many passes cost little more than their arithmetic."""
    names = df.columns

    def pack(batches):
        for chunk in chunked(batches, PACK):
            block = np.column_stack([numbers(chunk, n) for n in names])
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["x"])

    return df.mapInArrow(pack, "x binary")


def unpacked(chunk: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows of packed blocks."""
    return np.concatenate([np.frombuffer(b.as_buffer(), float).reshape(-1, width) for b in chunk.column("x")])


def summed(rows: DataFrame, make: Callable, size: int, parts: int | None = None, chunk: int = CHUNK) -> np.ndarray | None:
    """The sum of ``make(chunk)`` over all chunks of rows, a vector of ``size`` numbers; none without rows.

    Every partition gives one partial sum. The partial sums are added in two
    levels on the executors; where the table is known to have ``parts``
    partitions and these give few numbers, the driver adds them in one.
    """
    def partial(batches):
        total = None
        for part in chunked(batches, chunk):
            v = make(part)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["g"])

    found = rows.mapInArrow(partial, "g array<double>")
    if parts and parts * size <= GATHERED:
        done = found.collect()
        return np.array([r["g"] for r in done]).sum(axis=0) if done else None
    vectors = found.select(array_to_vector("g").alias("g"), F.pmod(F.xxhash64("g"), F.lit(GROUPS)).alias("k"))
    total = Summarizer.metrics("sum").summary(F.col("g")).getField("sum")
    row = vectors.groupBy("k").agg(total.alias("g")).agg(F.count(F.lit(1)).alias("n"), total.alias("g")).select("n", vector_to_array("g").alias("g")).first()
    return np.array(row["g"]) if row["n"] else None
