"""Row norms, clipping factors, clipped and noisy sums, data-driven thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.order import exact_order_statistics
from tabloom.functions.scalar import col, let, normal_ppf

STABILITY = 1e-6


def norm(v: Column) -> Column:
    """Euclidean norm of an array column."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def flat_norm(blocks: list[Column]) -> Column:
    """One norm over several blocks."""
    total = F.lit(0.0)
    for b in blocks:
        total = total + F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def thresholds_for(blocks: int, thresholds: list[float]) -> list[float]:
    """One threshold is repeated for every block; any other count must match."""
    if len(thresholds) == 1:
        return thresholds * blocks
    if len(thresholds) != blocks:
        raise ValueError(f"{len(thresholds)} thresholds for {blocks} blocks")
    return thresholds


def factor(n: Column, threshold: float | Column) -> Column:
    """min(1, C / (norm + 1e-6))."""
    c = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.least(F.lit(1.0), c / (n + STABILITY))


def clipped(v: Column, threshold: float) -> Column:
    """The array scaled so that its norm is at most the threshold."""
    return let(factor(norm(v), threshold), lambda f: F.transform(v, lambda x: x.cast("double") * f))


def clipped_sum(df: DataFrame, blocks: list[str], thresholds: list[float], per_block: bool = False) -> DataFrame:
    """(block, pos, total) plus the row count ``n``.

    Rows are scaled and added up in the map tasks; only one vector per task
    and block is shuffled. Sub-batches add up in the same way.
    """
    if per_block:
        c = thresholds_for(len(blocks), thresholds)
        factors = [factor(norm(col(b)), t) for b, t in zip(blocks, c)]
    else:
        if len(thresholds) != 1:
            raise ValueError("flat clipping takes one threshold")
        factors = [factor(flat_norm([col(b) for b in blocks]), thresholds[0])] * len(blocks)
    staged = df.select(*[array_to_vector(col(b)).alias(f"v{i}") for i, b in enumerate(blocks)],
                       *[f.alias(f"f{i}") for i, f in enumerate(factors)])
    scaled = staged.agg(F.count(F.lit(1)).alias("n"), *[
        Summarizer.metrics("sum").summary(F.col(f"v{i}"), F.col(f"f{i}")).getField("sum").alias(f"s{i}")
        for i in range(len(blocks))])
    items = F.array(*[F.struct(F.lit(i).alias("block"), vector_to_array(f"s{i}").alias("v")) for i in range(len(blocks))])
    rows = scaled.select("n", F.explode(items).alias("x")).select("n", "x.block", F.posexplode("x.v").alias("pos", "total"))
    return rows.select("block", "pos", "total", "n")


def noise_scale(thresholds: list[float], sigma: float) -> float:
    """Standard deviation of the noise; per-block thresholds combine as a 2-norm."""
    return sigma * math.sqrt(sum(t * t for t in thresholds))


def noisy_mean(df: DataFrame, blocks: list[str], thresholds: list[float], sigma: float, per_block: bool = False,
               expected: float | None = None, seed: int | None = None, u: Column | None = None) -> DataFrame:
    """(block, pos, value): clipped sum plus one normal draw per coordinate, over n or the expected batch.

    The noise is drawn once on the summed vector. A fixed ``seed`` is for
    experiments: noise that can be replayed protects nobody. So is ``u``, a given
    uniform of (block, pos).
    """
    total = clipped_sum(df, blocks, thresholds, per_block)
    repeated = thresholds_for(len(blocks), thresholds) if per_block else thresholds
    scale = noise_scale(repeated, sigma)
    if scale > 0 and u is not None:
        total = total.withColumn("total", F.col("total") + normal_ppf(u) * F.lit(scale))
    elif scale > 0:
        base = np.random.SeedSequence(seed).generate_state(2)
        draws = F.randn(int(base[0])) * F.lit(scale)
        total = total.coalesce(1).withColumn("total", F.col("total") + draws)
    over = F.lit(float(expected)) if expected else F.col("n")
    return total.select("block", "pos", (F.col("total") / over).alias("value"))


# --- thresholds from the data (experimental: these read the norms without privacy) --

def threshold_static(current: float) -> float:
    return current


def threshold_rank(df: DataFrame, column: str, ratio: float) -> float:
    """The k-th smallest norm, k = max(1, int(n (1 - ratio)))."""
    picked = exact_order_statistics(df, column, lambda n: [max(1, int(n * (1 - ratio)))])
    return next(iter(picked.values()))


def threshold_mean(df: DataFrame, column: str, ratio: float) -> DataFrame:
    """max(smallest, mean + ratio * sample deviation + 1e-8), as one aggregate row."""
    c = col(column)
    return df.agg(F.greatest(F.min(c), F.avg(c) + ratio * F.stddev_samp(c) + 1e-8).alias("threshold"))


def threshold_otsu(df: DataFrame, column: str) -> DataFrame:
    """Centre of the histogram bin that maximises the between-class variance.

    About 2 sqrt(n) equal bins; the running sums are over bins, not rows.
    """
    size = df.agg(F.count(col(column)).alias("n"), F.min(col(column)).alias("lo"), F.max(col(column)).alias("hi")).first()
    bins = 2 ** int(1 + math.log2(size["n"]) / 2)
    lo, width = size["lo"], (size["hi"] - size["lo"]) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((col(column) - lo) / width).cast("int"))
    hist = df.where(col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    hist = hist.withColumn("centre", F.lit(lo) + (F.col("bin") + 0.5) * width)
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    mass = F.col("w") * F.col("centre")
    sums = hist.select("bin", "centre", F.sum("w").over(upto).alias("w1"), F.sum(mass).over(upto).alias("m1"),
                       F.sum("w").over(after).alias("w2"), F.sum(mass).over(after).alias("m2"))
    gap = F.col("m1") / F.col("w1") - F.col("m2") / F.col("w2")
    between = sums.where(F.col("w2").isNotNull()).withColumn("between", F.col("w1") * F.col("w2") * gap * gap)
    return between.orderBy(F.desc("between"), "bin").limit(1).select(F.col("centre").alias("threshold"), "bin")


def clip_report(norms: DataFrame, thresholds: dict, quantiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """(block, threshold, quantiles, mean factor, share clipped) of rows (block, norm)."""
    spark = norms.sparkSession
    rows_of = {r["block"]: r["n"] for r in norms.where(col("norm").isNotNull()).groupBy("block").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for block, c in thresholds.items():
        picks = exact_order_statistics(
            norms.where(F.col("block") == F.lit(block)), "norm", lambda n: [max(1, math.ceil(q * n)) for q in quantiles])
        n = rows_of.get(block, 0)  # quantiles may share a rank, so each looks its own up
        if n:
            rows.append((block, float(c), *[float(picks[max(1, math.ceil(q * n))]) for q in quantiles]))
    names = [f"q{int(q * 100)}" for q in quantiles]
    table = spark.createDataFrame(rows, "block int, threshold double, " + ", ".join(f"{n} double" for n in names))
    joined = norms.join(F.broadcast(table), "block")
    return joined.groupBy("block", "threshold", *names).agg(
        F.avg(factor(F.col("norm"), F.col("threshold"))).alias("mean_factor"),
        F.avg((F.col("norm") > F.col("threshold")).cast("double")).alias("share_clipped"))
