"""Mean Gower distance over all real x synthetic pairs without forming pairs.

For a numeric feature the mean of |x - y| equals the integral of
F(1-G) + G(1-F) over the value axis; for a categorical feature the share of
unequal pairs is one minus the sum of p*q.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.fidelity.bins import bin_counts, crowded, numbered_columns, ordered_blocks
from tabloom.fidelity.pair import category_counts, cumulative, with_totals


def _within(c, k, v, r, s) -> dict:
    """Over a block's steps from value to value the sums of the step, the step by the rows passed of each table, and the step by both."""
    f, g, step = np.cumsum(r)[:-1], np.cumsum(s)[:-1], np.diff(v)
    return {"first": v[0], "last": v[-1], "r": r.sum(), "s": s.sum(), "sr": step @ f, "ss": step @ g, "srs": step @ (f * g)}


BLOCK = "c int, k bigint, first double, last double, r double, s double, sr double, ss double, srs double"


def _numeric_features(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """The integral block by block: inside a block the functions are its own running counts on top of those of the blocks before."""
    both = numbered_columns(real, synthetic, columns)
    ends = both.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    limits = {i: (ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(len(columns)) if ends[f"lo{i}"] is not None}
    rows, by_values = [], []
    bins = bin_counts(both, limits) if limits else None
    for i, part in bins.groupby("c") if limits else ():
        if crowded(part):
            by_values.append(columns[i])
            limits.pop(i)
    if limits:
        blocks = ordered_blocks(both, limits, bins[bins["c"].isin(list(limits))], _within, BLOCK)
        for i, b in blocks.sort_values(["c", "k"]).groupby("c"):
            R, S = b["r"].sum(), b["s"].sum()
            if R == 0 or S == 0:
                rows.append((columns[i], None))
                continue
            b = b.reset_index(drop=True)
            f0, g0 = (b["r"].cumsum() - b["r"]) / R, (b["s"].cumsum() - b["s"]) / S
            width = b["last"] - b["first"]
            # sum of step * (f + g - 2 f g) with f = f0 + own / R and g = g0 + own / S
            inside = (width * (f0 + g0 - 2 * f0 * g0) + (1 - 2 * g0) * b["sr"] / R + (1 - 2 * f0) * b["ss"] / S - 2 * b["srs"] / (R * S)).sum()
            f, g, jump = f0 + b["r"] / R, g0 + b["s"] / S, (b["first"].shift(-1) - b["last"]).fillna(0.0)
            between = (jump * (f * (1 - g) + g * (1 - f))).sum()
            low, high = limits[i]
            rows.append((columns[i], float(inside + between) / ((high - low) if high > low else 1.0)))
    out = real.sparkSession.createDataFrame(rows, "column string, distance double")
    return out.unionByName(_numeric_by_values(real, synthetic, by_values)) if by_values else out


def _numeric_by_values(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    c = cumulative(real, synthetic, columns)
    totals = c.groupBy("column").agg(F.sum("r").alias("R_"), F.sum("s").alias("S_"),
                                     (F.max("value") - F.min("value")).alias("range"))
    f, g = F.col("cum_r") / F.col("R_"), F.col("cum_s") / F.col("S_")
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    scale = F.when(F.col("range") > 0, F.col("range")).otherwise(F.lit(1.0))
    return c.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.sum(step * (f * (1 - g) + g * (1 - f)) / scale).alias("distance"))


def gower_features(real: DataFrame, synthetic: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """(column, distance): mean distance of one feature over all pairs."""
    parts = []
    if continuous:
        parts.append(_numeric_features(real, synthetic, continuous))
    if categorical:
        t = with_totals(category_counts(real, synthetic, categorical), ["column"])
        same = (F.col("r") / F.col("R_")) * (F.col("s") / F.col("S_"))
        parts.append(t.groupBy("column").agg((1 - F.sum(same)).alias("distance")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def gower_mean(real: DataFrame, synthetic: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    return gower_features(real, synthetic, continuous, categorical).agg(F.avg("distance").alias("gower"))
