"""Pairwise metrics: KL over cell shares, correlations and their difference."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.fidelity.pair import column_pairs, smoothed_kl, tagged
from tabloom.functions.scalar import clip, col, literal_array, nan_to_null

SMOOTHING = 1e-5
CELLS_PER_SIDE = 10
ORIGIN_ROWS = 100  # rows in which a value of every column is looked for first


def kl_continuous(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, kl, score) on a 10x10 grid with the real table's edges.

    A row becomes one cell number per pair; map tasks reduce them to at most
    100 cells per pair before anything is shuffled.
    """
    limits = nan_to_null(real).agg(*[a for i, c in enumerate(columns) for a in (
        F.min(col(c).cast("double")).alias(f"lo{i}"), F.max(col(c).cast("double")).alias(f"hi{i}"))]).first()
    both = tagged(real, synthetic, columns)
    bins = []
    for i, c in enumerate(columns):
        lo, span = limits[f"lo{i}"] or 0.0, (limits[f"hi{i}"] or 0.0) - (limits[f"lo{i}"] or 0.0)
        place = F.floor((col(c).cast("double") - lo) / span * CELLS_PER_SIDE) if span > 0 else F.when(col(c).isNotNull(), F.lit(0))
        bins.append(clip(place, 0, CELLS_PER_SIDE - 1).cast("int").alias(f"b{i}"))
    placed = both.select("r", "s", *bins)
    index = {c: i for i, c in enumerate(columns)}
    items = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 (F.col(f"b{index[a]}") * CELLS_PER_SIDE + F.col(f"b{index[b]}")).alias("cell"))
        for a, b in column_pairs(columns)])
    cells = (placed.select("r", "s", F.explode(items).alias("x")).select("r", "s", "x.*")
             .where(F.col("cell").isNotNull()).groupBy("column_a", "column_b", "cell")
             .agg(F.sum("r").alias("r"), F.sum("s").alias("s")))
    kl = smoothed_kl(cells, ["column_a", "column_b"], CELLS_PER_SIDE**2, SMOOTHING)
    return kl.withColumn("score", 1 / (1 + F.col("kl")))


def kl_discrete(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, kl, score) over the value pairs that occur."""
    both = tagged(real, synthetic, columns)
    if len(columns) == 2:  # the rows' cells are the pair's
        both = both.groupBy(*[col(c) for c in columns]).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    items = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 col(a).cast("string").alias("va"), col(b).cast("string").alias("vb"))
        for a, b in column_pairs(columns)])
    cells = (both.select("r", "s", F.explode(items).alias("x")).select("r", "s", "x.*")
             .groupBy("column_a", "column_b", "va", "vb").agg(F.sum("r").alias("r"), F.sum("s").alias("s")))
    kl = smoothed_kl(cells, ["column_a", "column_b"], None, SMOOTHING)
    return kl.withColumn("score", 1 / (1 + F.col("kl")))


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, n, sx, sy, sxx, syy, sxy): for column i against every column, arrays over the rows in which both are given.

    One pass: a task multiplies blocks of rows into matrices and hands on one
    row a column, and these are summed. Values are taken from a value of their
    column, so that sums of squares keep their digits.
    """
    d = len(columns)
    numbers = nan_to_null(df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
    seen = numbers.head(ORIGIN_ROWS)
    origin = [next((r[i] for r in seen if r[i] is not None), None) for i in range(d)]
    if None in origin:  # a column that begins with gaps
        origin = numbers.agg(*[F.first(f"x{i}", ignorenulls=True).alias(f"x{i}") for i in range(d)]).first()
    base = np.array([0.0 if v is None else v for v in origin])
    base[~np.isfinite(base)] = 0.0

    def run(batches):
        total = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - base
            given = ~np.isnan(x)
            x[~given] = 0.0
            m, square = given.astype(float), x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(np.moveaxis(total, 1, 0).reshape(d, 6 * d).tolist(), pa.list_(pa.float64()))],
            names=["i", "s"])

    parts = numbers.mapInArrow(run, "i int, s array<double>").select("i", array_to_vector("s").alias("s"))
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.metrics("sum").summary(F.col("s")).getField("sum")).alias("s"))
    return summed.select("i", *[F.slice("s", k * d + 1, d).alias(n) for k, n in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))])


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, corr) for every ordered pair, from one pass over the table.

    A pair counts the rows in which both columns are given. A constant column
    has no correlation (null).
    """
    names = literal_array(columns, "string")
    sums = pair_sums(df, columns).select("i", F.posexplode(F.arrays_zip("n", "sx", "sy", "sxx", "syy", "sxy")).alias("j", "p"))
    n, sx, sy = F.col("p.n"), F.col("p.sx"), F.col("p.sy")
    vx, vy = F.col("p.sxx") - sx * sx / n, F.col("p.syy") - sy * sy / n
    cov = F.col("p.sxy") - sx * sy / n
    same = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(cov / F.sqrt(vx * vy))
    value = F.when((n > 0) & (vx > 0) & (vy > 0), same)
    return sums.select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), value.alias("corr"))


def correlation_difference(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    a = correlation(real, columns).withColumnRenamed("corr", "real")
    b = correlation(synthetic, columns).withColumnRenamed("corr", "synthetic")
    return a.join(b, ["column_a", "column_b"]).withColumn("difference", F.col("real") - F.col("synthetic"))


def correlation_rmse(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    d = correlation_difference(real, synthetic, columns)
    return d.agg(F.sqrt(F.avg(F.col("difference") * F.col("difference"))).alias("rmse"))
