"""Columns of a real and a synthetic table counted in fine bins, and put in order block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabloom.fidelity.pair import tagged
from tabloom.functions.scalar import col
from tabloom.functions.sums import chunked, numbers

BINS = 1 << 15  # of a column, between two limits
BLOCK_ROWS = 1_000_000  # rows of a column that one task puts in order


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = (x + 0.0).view(np.uint64)  # adding zero removes the sign of a negative zero
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _steps(low: float, high: float) -> tuple[int, int]:
    """The place of ``low`` in the order of all doubles, and the bits of a bin's width."""
    a, b = (int(v) for v in ordered(np.array([low, high])))
    return a, max(0, (b - a).bit_length() - (BINS.bit_length() - 1))


def placed(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The bin of every number: one below ``low``, ``BINS`` from it to ``high`` by equal steps of the numbers
    that a double can hold, so that a far value leaves the others their bins, and one above."""
    a, shift = _steps(low, high)
    key = ordered(x)
    place = ((key - np.uint64(a)) >> np.uint64(shift)).astype(np.int64) + 1
    place[x < low] = 0
    place[x > high] = BINS + 1
    return place


def span(first: int, last: int, low: float, high: float) -> tuple[float, float]:
    """Numbers between which the bins ``first`` to ``last`` lie."""
    a, shift = _steps(low, high)

    def number(key: int) -> float:
        bits = key ^ (1 << 63) if key >> 63 else ~key & (2**64 - 1)
        return float(np.array([bits], np.uint64).view(float)[0])

    begin = -np.inf if first < 1 else high if first > BINS else number(a + ((int(first) - 1) << shift))
    end = a + (int(last) << shift)
    return float(begin), np.inf if last > BINS or end >= 2**64 or not np.isfinite(number(end)) else number(end)


def numbered_columns(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(r, x0, x1, ...): both tables' columns as doubles, r is 1 on real rows."""
    return tagged(real, synthetic, columns).select("r", *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def bin_counts(both: DataFrame, limits: dict[int, tuple[float, float]]) -> pd.DataFrame:
    """(c, b, r, s, many): rows of each table in every bin of every column, and whether it holds different values."""
    def count(batches):
        kept = {c: (np.zeros(BINS + 2, np.int64), np.zeros(BINS + 2, np.int64), np.full(BINS + 2, np.nan), np.zeros(BINS + 2, bool)) for c in limits}
        for chunk in chunked(batches):
            real = chunk.column("r").to_numpy() > 0
            for c, (low, high) in limits.items():
                x = numbers(chunk, f"x{c}")
                given = ~np.isnan(x)
                x, mine = x[given] + 0.0, real[given]
                place = placed(x, low, high)
                r, s, seen, many = kept[c]
                r += np.bincount(place[mine], minlength=BINS + 2)
                s += np.bincount(place[~mine], minlength=BINS + 2)
                new = np.isnan(seen[place])
                seen[place[new]] = x[new]
                many[place[seen[place] != x]] = True
        for c, (r, s, seen, many) in kept.items():
            at = np.flatnonzero(r + s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(r[at]), pa.array(s[at]),
                 pa.array(seen[at]), pa.array(many[at])], names=["c", "b", "r", "s", "v", "many"])

    parts = both.mapInArrow(count, "c int, b int, r bigint, s bigint, v double, many boolean")
    bins = parts.groupBy("c", "b").agg(F.sum("r").alias("r"), F.sum("s").alias("s"), (F.max("many") | (F.min("v") < F.max("v"))).alias("many"))
    return bins.toArrow().to_pandas().sort_values(["c", "b"])  # BINS + 2 rows a column at most


def crowded(part: pd.DataFrame) -> bool:
    """Whether a bin of a column has so many rows with different values that no task should order them."""
    return bool((part["many"] & (part["r"] + part["s"] > BLOCK_ROWS)).any())


def ordered_blocks(both: DataFrame, limits: dict[int, tuple[float, float]], bins: pd.DataFrame, reduce, schema: str) -> pd.DataFrame:
    """``reduce(c, k, v, r, s)`` of every block ``k`` of every column ``c``, one row each: its different values in order and their counts in each table.

    A block is a range of bins with about ``BLOCK_ROWS`` rows, more where a bin has more. Repeats collapse before the
    shuffle, which moves packed values.
    """
    block = {}
    for c, part in bins.groupby("c"):
        size = np.zeros(BINS + 2, np.int64)
        size[part["b"]] = part["r"] + part["s"]
        block[c] = (np.cumsum(size) - size) // BLOCK_ROWS

    def deal(batches):
        for chunk in chunked(batches):
            real = chunk.column("r").to_numpy() > 0
            for c, blocks in block.items():
                x = numbers(chunk, f"x{c}")
                given = ~np.isnan(x)
                v, at, n = np.unique(x[given] + 0.0, return_inverse=True, return_counts=True)
                if not len(v):
                    continue
                r = np.bincount(at, weights=real[given], minlength=len(v))
                k = blocks[placed(v, *limits[c])]  # rises with the values
                cells = np.stack([v, r, n - r])
                firsts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                parts = [cells[:, a:b].tobytes() for a, b in zip(firsts, np.append(firsts[1:], len(v)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts), c, np.int32)), pa.array(k[firsts]), pa.array(parts, pa.binary())], names=["c", "k", "p"])

    def gather(key, table):
        cells = np.concatenate([np.frombuffer(p.as_buffer(), float).reshape(3, -1) for p in table.column("p").combine_chunks()], axis=1)
        v, at = np.unique(cells[0], return_inverse=True)
        c, k = key[0].as_py(), key[1].as_py()
        found = reduce(c, k, v, np.bincount(at, weights=cells[1]), np.bincount(at, weights=cells[2]))
        return pa.Table.from_pylist([{"c": c, "k": k, **found}], schema=told)

    dealt = both.mapInArrow(deal, "c int, k bigint, p binary")
    told = to_arrow_schema(both.sparkSession.createDataFrame([], schema).schema)
    return dealt.groupBy("c", "k").applyInArrow(gather, schema).toArrow().to_pandas()  # a row a block
