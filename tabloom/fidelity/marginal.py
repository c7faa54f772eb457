"""Column-by-column metrics: chi-square, KS distance, side-by-side histograms."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.fidelity.bins import BINS, bin_counts, crowded, numbered_columns, placed, span
from tabloom.fidelity.pair import category_counts, cumulative, with_totals
from tabloom.functions.scalar import col, nan_to_null
from tabloom.functions.sums import chunked, numbers
from tabloom.operators.table import TableEncoder

HISTOGRAM_BINS = 10
UNSEEN = 2.0  # beyond the last interval of a category column, which ends at 1


def chi_square(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, statistic, dof) of synthetic counts against smoothed real shares."""
    t = with_totals(category_counts(real, synthetic, columns), ["column"])
    expected = F.col("S_") * (F.col("r") + 0.5) / (F.col("R_") + F.col("K_") / 2)
    gap = F.col("s") - expected
    return t.groupBy("column").agg(F.sum(gap * gap / expected).alias("statistic"),
                                   (F.count(F.lit(1)) - 1).alias("dof"))


def chi_square_tail(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised gamma, series or fraction)."""
    if dof <= 0 or statistic <= 0:
        return 1.0
    a, x = dof / 2, statistic / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    # continued fraction evaluated from the far end
    value = 0.0
    for i in range(400, 0, -1):
        value = i * (i - a) / (x + 2 * i + 1 - a - value)
    return min(1.0, front / (x + 1 - a - value))


def chi_square_score(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> float:
    """Mean p-value over the columns (one collected row per column)."""
    rows = chi_square(real, synthetic, columns).collect()
    return sum(chi_square_tail(r["statistic"], r["dof"]) for r in rows) / len(rows)


def _inside(both: DataFrame, limits: dict[int, tuple[float, float]], open_bins: pd.DataFrame) -> dict[int, float]:
    """The largest gap of the two distribution functions at the values inside some bins, by column."""
    wanted = {c: np.isin(np.arange(BINS + 2), part["b"]) for c, part in open_bins.groupby("c")}
    # other columns, and rows outside the span of a column's bins, need not leave the JVM
    spans = [F.col(f"x{c}").between(*span(part["b"].min(), part["b"].max(), *limits[c])) for c, part in open_bins.groupby("c")]
    both = both.select("r", *[f"x{c}" for c in wanted]).where(reduce(lambda a, b: a | b, spans))

    def values(batches):
        for chunk in chunked(batches):
            real = chunk.column("r").to_numpy() > 0
            for c, chosen in wanted.items():
                x = numbers(chunk, f"x{c}")
                given = ~np.isnan(x)
                x, mine = x[given] + 0.0, real[given]
                place = placed(x, *limits[c])
                some = chosen[place]
                v, at, n = np.unique(x[some], return_inverse=True, return_counts=True)
                r = np.bincount(at[mine[some]], minlength=len(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), c, np.int32)), pa.array(placed(v, *limits[c]).astype(np.int32)), pa.array(v),
                     pa.array(r.astype(np.int64)), pa.array((n - r).astype(np.int64))], names=["c", "b", "v", "r", "s"])

    found = both.mapInArrow(values, "c int, b int, v double, r bigint, s bigint").groupBy("c", "b", "v").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    told = open_bins[["c", "b", "r0", "s0", "all_r", "all_s"]].astype({"c": "int32", "b": "int32"})
    upto = Window.partitionBy("c", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    f, g = (F.sum("r").over(upto) + F.col("r0")) / F.col("all_r"), (F.sum("s").over(upto) + F.col("s0")) / F.col("all_s")
    gaps = found.join(F.broadcast(both.sparkSession.createDataFrame(told)), ["c", "b"]).select("c", F.abs(f - g).alias("gap"))
    return {r["c"]: r["gap"] for r in gaps.groupBy("c").agg(F.max("gap").alias("gap")).collect()}


def _ks_by_values(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    c = cumulative(real, synthetic, columns)
    totals = c.groupBy("column").agg(F.sum("r").alias("R_"), F.sum("s").alias("S_"))
    gap = F.abs(F.col("cum_r") / F.col("R_") - F.col("cum_s") / F.col("S_"))
    joined = c.join(F.broadcast(totals), "column")
    return joined.groupBy("column").agg(F.max(gap).alias("distance"))


def ks(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distance, score): largest gap of the two distribution functions.

    Both functions are known exactly at the ends of fine bins from one pass
    without a shuffle of values. Inside a bin they cannot be further apart than
    the end of one and the begin of the other, so only values of bins in which
    that is more than the largest gap at any end are looked at one by one. Where
    such a bin is large, or a table has no number, all values are put in order.
    """
    both = numbered_columns(real, synthetic, columns)
    ends = both.where("r = 1").agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    limits = {i: (ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(len(columns)) if ends[f"lo{i}"] is not None}
    distances, by_values, still = {}, [c for i, c in enumerate(columns) if i not in limits], []
    for i, part in bin_counts(both, limits).groupby("c") if limits else ():
        R, S = int(part["r"].sum()), int(part["s"].sum())
        if R == 0 or S == 0:
            by_values.append(columns[i])
            continue
        f, g = part["r"].cumsum() / R, part["s"].cumsum() / S
        distances[i] = float((f - g).abs().max())
        f0, g0 = (part["r"].cumsum() - part["r"]) / R, (part["s"].cumsum() - part["s"]) / S
        wide = part["many"] & (np.maximum(f - g0, g - f0) > distances[i])
        left = part.assign(r0=part["r"].cumsum() - part["r"], s0=part["s"].cumsum() - part["s"], all_r=float(R), all_s=float(S))[wide]
        if crowded(left):
            by_values.append(columns[i])
            distances.pop(i)
        elif len(left):
            still.append(left)
    if still:
        for i, gap in _inside(both, limits, pd.concat(still)).items():
            distances[i] = max(distances[i], gap)
    rows = [(columns[i], d) for i, d in distances.items()]
    out = real.sparkSession.createDataFrame(rows, "column string, distance double")
    if by_values:
        out = out.unionByName(_ks_by_values(real, synthetic, by_values))
    return out.withColumn("score", 1 - F.col("distance"))


def numeric_view(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables as numbers under encoders fitted on the real one.

    A synthetic category that the real table lacks gets a number past all others.
    """
    encoder = TableEncoder().fit(real.select(*[col(c) for c in columns]))

    def apply(df):
        given = [col(c).isNotNull().alias(f"_given_{i}") for i, c in enumerate(columns)]
        out = encoder.transform(nan_to_null(df).select(*[col(c) for c in columns], *given))
        return out.select(*[F.when(F.col(f"_given_{i}"), F.coalesce(col(f"{c}__value"), F.lit(UNSEEN))).alias(c)
                            for i, c in enumerate(columns)])
    return apply(real), apply(synthetic)


def ks_extended(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    a, b = numeric_view(real, synthetic, columns)
    return ks(a, b, columns)


def histogram_numeric(real: DataFrame, synthetic: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, source, bin, n): equal bins over each table's own range, last bin closed."""
    def one(df, source):
        df = nan_to_null(df)
        limits = df.agg(*[a for i, c in enumerate(columns) for a in (
            F.min(col(c).cast("double")).alias(f"lo{i}"), F.max(col(c).cast("double")).alias(f"hi{i}"))]).first()
        items = []
        for i, c in enumerate(columns):
            lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
            if lo is None:
                continue
            x = (col(c).cast("double") - lo) / ((hi - lo) or 1.0) * bins
            items.append(F.struct(F.lit(c).alias("column"), F.least(F.lit(bins), F.floor(x) + 1).cast("int").alias("bin"),
                                  col(c).isNotNull().alias("ok")))
        rows = df.select(F.explode(F.array(*items)).alias("x")).select("x.*").where("ok")
        return rows.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(source))
    return one(real, "real").unionByName(one(synthetic, "synthetic"))


def histogram_categories(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, real, synthetic) counts."""
    return category_counts(real, synthetic, columns).withColumnsRenamed({"r": "real", "s": "synthetic"})
