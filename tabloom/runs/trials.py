"""Trial tables: settings, non-dominated trials, the best of the front."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.order import block_count
from tabloom.functions.scalar import col
from tabloom.functions.skew import skew_join
from tabloom.session import checkpoint

CHUNK = 512    # rows compared at once
BLOCK_ROWS = 10_000  # different vectors that are worth a block
CORNERS = 64   # vectors that every block compares its rows with first
FRONT = "blk int, v array<double>"


def stepped(u: Column, low: float, high: float, step: float, integer: bool = False) -> Column:
    """low + step * k, k uniform over the steps that stay within high."""
    count = int((high - low) / step + 1e-9) + 1
    value = F.lit(low) + F.lit(step) * F.floor(u * count)
    return value.cast("bigint") if integer else value.cast("double")


def trial_settings(trials: DataFrame, settings: dict[str, tuple], draw) -> DataFrame:
    """Append one column per setting (low, high, step, integer); ``draw(i)`` gives its uniform."""
    return trials.withColumns({
        name: stepped(draw(i), *spec) for i, (name, spec) in enumerate(settings.items())})


def covered(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows have a row in ``by`` at least as good in every column."""
    if not len(by) or not len(rows):
        return np.zeros(len(rows), bool)
    if rows.shape[1] == 0:
        return np.ones(len(rows), bool)
    if rows.shape[1] == 1:
        return rows[:, 0] <= by[:, 0].max()
    if rows.shape[1] == 2:  # the best second value among those that are as good in the first
        order = np.argsort(-by[:, 0], kind="stable")
        as_good = np.searchsorted(-by[order, 0], -rows[:, 0], "right")
        best = np.append(-np.inf, np.maximum.accumulate(by[order, 1]))
        return rows[:, 1] <= best[as_good]
    out = np.zeros(len(rows), bool)
    for at in range(0, len(by), CHUNK):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        part = by[at:at + CHUNK]
        for some in np.array_split(left, -(-len(left) // CHUNK)):
            out[some] = (part[None] >= rows[some][:, None]).all(axis=2).any(axis=1)
    return out


def local_front(rows: np.ndarray) -> np.ndarray:
    """Which of different rows, in falling order, no other dominates: halves first, then the upper half's front over the lower's.

    An earlier row is as good in the first column, so the others decide.
    """
    keep = np.ones(len(rows), bool)
    if len(rows) < 2:
        return keep
    half = len(rows) // 2
    keep[:half], keep[half:] = local_front(rows[:half]), local_front(rows[half:])
    low = half + np.flatnonzero(keep[half:])
    keep[low[covered(rows[low][:, 1:], rows[:half][keep[:half]][:, 1:])]] = False
    return keep


def _falling(rows: np.ndarray) -> np.ndarray:
    """Different rows in falling order."""
    return np.unique(rows, axis=0)[::-1] if rows.shape[1] else rows[:1]


def listed(block: int, rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"blk": np.full(len(rows), block, np.int32), "v": pd.Series(rows.tolist(), dtype=object)})


def pareto_front(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """Trials that no other trial dominates, all metrics maximised; rows lacking a metric are left out.

    Different metric vectors are dealt to blocks in falling order, so that only
    a vector of an earlier block can dominate one of a later block. Every block
    finds its own front, after a few of the best vectors have removed most
    rows. What earlier blocks have to say to a later one is the front of their
    other metrics, which is merged in a tree: block i reads the merged front of
    one subtree for each set bit of i. No task holds more than a block's front
    and those of the trees it reads, and nothing is gathered on the driver.
    """
    names = [f"_m{i}" for i in range(len(metrics))]
    wide = trials.withColumns({n: col(m).cast("double") + F.lit(0.0) for n, m in zip(names, metrics)}).na.drop(subset=names)
    vectors = wide.select(*names).distinct()
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    best = vectors.groupBy(F.pmod(F.xxhash64(*names), F.lit(CORNERS)).alias("k")).agg(
        F.max_by(F.struct(*names), total).alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most CORNERS rows
    corners = np.array([list(r["b"]) for r in best], float).reshape(-1, len(names))
    parts = min(block_count(trials), 1 + sum(r["n"] for r in best) // BLOCK_ROWS)

    def own_front(batches):
        from pyspark.taskcontext import TaskContext

        block, front = TaskContext.get().partitionId(), np.zeros((0, len(names)))
        for pdf in batches:
            rows = pdf[names].to_numpy(float)
            worse = np.zeros(len(rows), bool)
            for c in corners:
                worse |= (c >= rows).all(axis=1) & (c > rows).any(axis=1)
            rows = rows[~worse]
            rows = rows[~covered(rows[:, 1:], front[:, 1:])]
            front = np.concatenate([front, rows[local_front(rows)]])
        yield listed(block, front)

    falling = [F.desc(n) for n in names]
    dealt = vectors.repartitionByRange(parts, *falling).sortWithinPartitions(*falling)
    fronts = checkpoint(dealt.mapInPandas(own_front, FRONT))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _falling(np.stack(pdf["v"].to_numpy()))
        return listed(pdf["blk"].iloc[0], rows[local_front(rows)] if rows.shape[1] else rows)

    def rows_of(front: DataFrame) -> DataFrame:
        found = checkpoint(front.select(*[F.get("v", i).alias(n) for i, n in enumerate(names)]))
        return skew_join(wide, found, names).select(*[col(c) for c in trials.columns])

    if parts == 1:
        return rows_of(fronts)
    told, level = [], fronts.select("blk", F.slice("v", 2, len(names)).alias("v"))
    for height in range((parts - 1).bit_length()):
        level = checkpoint(level.groupBy("blk").applyInPandas(merged, FRONT))
        first = ((F.col("blk") + 1) * 2**height).cast("int")  # the blocks of the subtree to the right
        told.append(level.where((F.col("blk") % 2 == 0) & (first < parts)).select(
            F.explode(F.sequence(first, F.least(first + 2**height, F.lit(parts)) - 1)).alias("blk"), "v"))
        level = level.select(F.floor(F.col("blk") / 2).cast("int").alias("blk"), "v")

    def keep(own: pd.DataFrame, better: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own[["v"]]
        rows = np.stack(own["v"].to_numpy())
        if not len(better):
            return own[["v"]]
        return own[["v"]][~covered(rows[:, 1:], np.stack(better["v"].to_numpy()).reshape(len(better), -1))]

    others = reduce(DataFrame.unionByName, told)
    left = fronts.groupBy("blk").cogroup(others.groupBy("blk")).applyInPandas(keep, "v array<double>")
    return rows_of(left)


def best_trial(trials: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """The front's trial with the highest mean metric (smallest key on ties)."""
    mean = sum((col(m) for m in metrics[1:]), col(metrics[0])) / len(metrics)
    return pareto_front(trials, metrics).withColumn("mean_metric", mean).orderBy(F.desc("mean_metric"), col(key)).limit(1)


