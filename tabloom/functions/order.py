"""Order statistics and running sums without a global sort in one task.

Running sums are taken in two levels: values are put into blocks whose edges
come from one quantile sketch, block totals (a few hundred rows) give every
block its offset, and only the inside of a block is sorted.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import col

SKETCH_ACCURACY = 10_000
COLLECT_BOUND = 20_000


def block_count(df: DataFrame) -> int:
    """As many blocks as there are shuffle tasks."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_edges(df: DataFrame, columns: list[str], blocks: int | None = None) -> dict[str, list[float]]:
    """Inner block edges per numeric column from one sketch pass over all of them, within the sketch's resolution."""
    blocks = blocks or min(block_count(df), SKETCH_ACCURACY // 10)
    if blocks < 2:
        return {c: [] for c in columns}
    probs = [i / blocks for i in range(1, blocks)]
    row = df.agg(*[
        F.percentile_approx(col(c).cast("double"), probs, 20 * blocks).alias(str(i))
        for i, c in enumerate(columns)
    ]).first()
    return {c: sorted(set(row[i] or [])) for i, c in enumerate(columns)}


def add_bucket(df: DataFrame, column: str, edges: list[float], out: str) -> DataFrame:
    """Append the index of the bucket that holds ``column`` (edge belongs to the right)."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *[float(e) for e in edges], math.inf]
    bucketed = Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)
    return bucketed.withColumn(out, col(out).cast("int"))


def exact_order_statistics(df: DataFrame, column: str, ranks) -> dict[int, float]:
    """The exact k-th smallest non-null values for a few 1-based ranks.

    ``ranks`` is a list or a function of the row count. Each pass brackets a
    rank with a sketch and counts what lies below; the bracket shrinks by about
    the sketch accuracy per pass until its distinct values can be collected.
    """
    base = df.select(col(column).alias("v")).where(F.col("v").isNotNull())
    size = _size(base)
    wanted = list(ranks(size["n"])) if callable(ranks) else list(ranks)
    if any(k < 1 or k > size["n"] for k in wanted):
        raise ValueError(f"ranks {wanted} must lie in 1..{size['n']}")
    if size["d"] <= COLLECT_BOUND // 2:
        return _pick(base, {k: k for k in wanted})
    return {k: v for rank in wanted for k, v in _narrow(base, rank, size).items()}


def _size(rows: DataFrame):
    return rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d")).first()


def _pick(rows: DataFrame, wanted: dict[int, int]) -> dict[int, float]:
    """Values at the given positions of a window with few distinct values."""
    seen, out = 0, {}
    for r in rows.groupBy("v").count().orderBy("v").collect():
        out.update({k: r["v"] for k, place in wanted.items() if seen < place <= seen + r["count"]})
        seen += r["count"]
    return out


def _narrow(base: DataFrame, rank: int, size) -> dict[int, float]:
    window, place = base, rank
    while size["d"] > COLLECT_BOUND // 2:
        margin, p = 2.0 / SKETCH_ACCURACY, place / size["n"]
        lo, hi = window.agg(F.percentile_approx(
            "v", [max(0.0, p - margin), min(1.0, p + margin)], SKETCH_ACCURACY).alias("q")).first()["q"]
        # the sketch works in doubles: widen by their rounding for wide integers
        lo, hi = _widen(lo, -1), _widen(hi, 1)
        below = base.where(F.col("v") < F.lit(lo)).count()
        window = base.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        size, place = _size(window), rank - below
        if not 1 <= place <= size["n"]:
            raise RuntimeError(f"rank {rank} fell outside its bracket [{lo}, {hi}]")
    return _pick(window, {rank: place})


def _widen(v, sign: int):
    if not isinstance(v, int):
        return v
    return max(-2**63, min(2**63 - 1, v + sign * ((abs(v) >> 50) + 1)))


TOP_LIMIT = 100_000  # rows that one task sorts


def top_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """Exactly the first ``n`` rows in the order of keys of any type and direction, or all where there are fewer.

    Rows are dealt to blocks by ranges of the whole key; counts say which blocks
    are in, and only the block at the border is cut, again by ranges where it is
    large. So no task holds more than a block, whatever ``n`` is. Rows with
    equal keys are told apart by a hash of their content.
    """
    by = [col(o) for o in order]
    if n <= TOP_LIMIT:
        return df.orderBy(*by).limit(n)
    names, tie = df.columns, "_tie"
    rows, taken = df.withColumn(tie, F.xxhash64(*[col(c) for c in names])), []
    parts = max(2, block_count(df))
    while n > 0:
        ranged = ordered_blocks(rows, [*by, F.col(tie)], parts)
        counts = {r["blk"]: r["count"] for r in ranged.groupBy("blk").count().collect()}  # a row a block
        inside, border = [], None
        for b in sorted(counts):
            if counts[b] > n:
                border = b
                break
            inside.append(b)
            n -= counts[b]
        taken.append(ranged.where(F.col("blk") <= (inside[-1] if inside else -1)).drop("blk"))
        if border is None or n == 0:
            break
        rest = ranged.where(F.col("blk") == border).drop("blk")
        if counts[border] <= TOP_LIMIT:
            taken.append(rest.orderBy(*by, tie).limit(n))
            break
        if len(counts) == 1:  # ranges cannot part the rows any more
            same = rest.select(tie).distinct().limit(2).count() == 1
            taken.append(numbered(rest, "_number").where(F.col("_number") < n).drop("_number") if same
                         else rest.orderBy(*by, tie).limit(n))
            break
        rows = rest
    return reduce(DataFrame.unionByName, taken).select(*[col(c) for c in names]) if taken else df.limit(0)


def running_totals(counts: DataFrame, group: list[str], block: str, order: list[Column],
                   measures: list[str], next_of: str | None = None) -> DataFrame:
    """Inclusive running sums of ``measures`` in ``order`` within ``group``.

    ``counts`` holds one row per (group, order key) with its block; blocks are
    numbered in order. Adds ``cum_<measure>`` and, when ``next_of`` names a
    column, ``next_value``: that column's value in the following row.
    """
    firsts = [F.min(next_of).alias("_first")] if next_of else []
    totals = counts.groupBy(*group, block).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures], *firsts)
    by_block = Window.partitionBy(*group).orderBy(block)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    leads = [F.lead("_first").over(by_block).alias("_next_first")] if next_of else []
    offsets = totals.select(
        *group, block,
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures], *leads)
    inner = Window.partitionBy(*group, block).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    following = [F.coalesce(F.lead(next_of).over(inner), F.col("_next_first")).alias("next_value")] if next_of else []
    # null-safe, so that a null group keeps its rows
    named = offsets.withColumnsRenamed({c: f"_g_{c}" for c in (*group, block)})
    same = reduce(lambda a, b: a & b, [counts[c].eqNullSafe(named[f"_g_{c}"]) for c in (*group, block)])
    return counts.join(named, same).select(
        *counts.columns,
        *[(F.sum(m).over(upto) + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures], *following)


def long_values(df: DataFrame, columns: list[str], edges: dict[str, list[float]],
                keep: list[Column] = ()) -> DataFrame:
    """Rows (keep..., column, value, blk), one per non-null value of ``columns``."""
    out = df.select(*keep, *[col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        out = add_bucket(out, f"_v{i}", edges.get(c, []), f"_b{i}")
    kept = [n for n in out.columns if not n.startswith(("_v", "_b"))]
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("value"), F.col(f"_b{i}").alias("blk"))
        for i, c in enumerate(columns)
    ])
    return (out.select(*kept, F.explode(items).alias("_x"))
            .select(*kept, "_x.column", "_x.value", "_x.blk")
            .where(F.col("value").isNotNull()))


def ordered_blocks(df: DataFrame, order: list[Column], blocks: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and freeze the partition number as ``blk``.

    For order keys of any type. The checkpoint keeps block numbers stable when
    executors are lost.
    """
    from tabloom.session import checkpoint

    parts = blocks or block_count(df)
    return checkpoint(df.repartitionByRange(parts, *order).withColumn("blk", F.spark_partition_id()))


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Rows numbered from 0, from a count per written partition and the offsets of the partitions.

    The rows are written once, so a retried task gives the same numbers.
    """
    from tabloom.session import checkpoint

    held = checkpoint(df.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = held.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.select(*[col(c) for c in df.columns], (F.col("_before") + place).alias(out))


SCAN_BLOCK = 256


def decayed_sums(y: np.ndarray, decay: float, block: int = SCAN_BLOCK) -> np.ndarray:
    """t_i = y_i + decay * t_(i-1) from zero, by blocks: each block times a triangle of decay powers,
    and the blocks' carries by the same scan with the decay of a whole block."""
    n = len(y)
    if n == 0:
        return y.astype(float)
    size = min(block, n)
    back = np.arange(size)[:, None] - np.arange(size)
    triangle = np.where(back >= 0, np.power(float(decay), np.maximum(back, 0)), 0.0)
    if n <= block:
        return triangle @ y
    rows = np.zeros(-(-n // size) * size)
    rows[:n] = y
    inner = rows.reshape(-1, size) @ triangle.T
    carry = decayed_sums(inner[:-1, -1], decay**size, block)
    inner[1:] += np.power(float(decay), np.arange(1, size + 1)) * carry[:, None]
    return inner.reshape(-1)[:n]


def segmented_sums(y: np.ndarray, starts: np.ndarray, decay: float) -> np.ndarray:
    """``decayed_sums`` of the stretches that begin at ``starts``: long ones by blocks, short ones all at once by place."""
    out = y.astype(float).copy()
    ends = np.append(starts[1:], len(y))
    sizes = ends - starts
    for a, b in zip(starts[sizes > SCAN_BLOCK], ends[sizes > SCAN_BLOCK]):
        out[a:b] = decayed_sums(out[a:b], decay)
    short = starts[sizes <= SCAN_BLOCK]
    left = sizes[sizes <= SCAN_BLOCK]
    for place in range(1, int(left.max(initial=1))):
        short, left = short[left > place], left[left > place]
        out[short + place] += decay * out[short + place - 1]
    return out


def linear_recurrence(df: DataFrame, series: list[str], order: list[str], value: str, decay: float,
                      start: float, out: str) -> DataFrame:
    """t_i = (1 - decay) * x_i + decay * t_(i-1) per series in order, t_0 = ``start``.

    A series is scanned in range partitions, so a long one is split over tasks:
    each task carries a running value from zero and how many steps it has made,
    the carries of a series' partitions are chained (one entry per partition),
    and every row adds its partition's incoming carry times decay^steps.
    """
    import pandas as pd
    from pyspark.taskcontext import TaskContext

    from tabloom.session import checkpoint

    keys = [c for c in df.columns]

    def scan(batches):
        part, last, t, steps = TaskContext.get().partitionId(), None, 0.0, 0
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in series:  # nulls are equal to each other
                codes = pd.factorize(pdf[c])[0]
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(None if pd.isna(v) else v for v in pdf[series].iloc[0])
            new[0] = first != last
            goes_on = not new[0]
            starts = np.unique(np.append(0, np.flatnonzero(new)))
            y = (1 - decay) * pdf[value].to_numpy(float)
            if goes_on:
                y[0] += decay * t
            made = segmented_sums(y, starts, decay)
            count = np.arange(1, n + 1) - np.repeat(starts, np.diff(np.append(starts, n)))
            if goes_on:
                count[:starts[1] if len(starts) > 1 else n] += steps
            last, t, steps = tuple(None if pd.isna(v) else v for v in pdf[series].iloc[-1]), float(made[-1]), int(count[-1])
            yield pdf.assign(_t=made, _k=count, blk=part)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _t double, _k bigint, blk int"
    parts = df.repartitionByRange(block_count(df), *[col(c) for c in (*series, *order)])
    scanned = checkpoint(parts.sortWithinPartitions(*series, *order).mapInPandas(scan, schema))
    last = scanned.groupBy(*series, "blk").agg(F.max_by("_t", "_k").alias("end"), F.max("_k").alias("n"))
    d = F.lit(decay)
    chain = Window.partitionBy(*series).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*series, "blk", F.aggregate(
        F.collect_list(F.struct("end", "n")).over(chain), F.lit(float(start)),
        lambda acc, e: e["end"] + F.pow(d, e["n"]) * acc).alias("_in"))
    named = carried.withColumnsRenamed({c: f"_g_{c}" for c in (*series, "blk")})
    same = reduce(lambda a, b: a & b, [scanned[c].eqNullSafe(named[f"_g_{c}"]) for c in (*series, "blk")])
    done = scanned.join(named, same)
    return done.select(*keys, (F.col("_t") + F.pow(d, F.col("_k")) * F.col("_in")).alias(out))
