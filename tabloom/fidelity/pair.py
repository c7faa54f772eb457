"""A real and a synthetic table side by side, reduced to value counts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.order import long_values, quantile_edges, running_totals
from tabloom.functions.scalar import col, nan_to_null
from tabloom.session import checkpoint


def tagged(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables with counters: r is 1 on real rows, s is 1 on synthetic rows. NaN is a missing value."""
    def mark(df, r, s):
        return nan_to_null(df.select(*[col(c) for c in columns])).select("*", F.lit(r).cast("bigint").alias("r"), F.lit(s).cast("bigint").alias("s"))
    return mark(real, 1, 0).unionByName(mark(synthetic, 0, 1))


def category_counts(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, r, s): occurrences of every value in each table, null as a value."""
    both = tagged(real, synthetic, columns)
    items = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return (both.select("r", "s", F.explode(items).alias("x")).groupBy("x.column", "x.value")
            .agg(F.sum("r").alias("r"), F.sum("s").alias("s")))


def numeric_counts(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, blk, value, r, s) over distinct values, in blocks of similar size.

    Repeats collapse in the map tasks; the blocks keep later running sums from
    sorting a whole column in one task.
    """
    both = tagged(real, synthetic, columns)
    edges = quantile_edges(both, columns)
    rows = long_values(both, columns, edges, [F.col("r"), F.col("s")])
    return rows.groupBy("column", "blk", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def with_totals(counts: DataFrame, key: list[str]) -> DataFrame:
    """Add R, S (sums) and K (cells) per key; the totals table has one row per key."""
    totals = counts.groupBy(*key).agg(F.sum("r").alias("R_"), F.sum("s").alias("S_"), F.count(F.lit(1)).alias("K_"))
    return counts.join(F.broadcast(totals), key)


def cumulative(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cum_r, cum_s, next_value) per distinct value."""
    # written once: totals, offsets and running sums all read the distinct values, not the tables
    counts = checkpoint(numeric_counts(real, synthetic, columns))
    return running_totals(counts, ["column"], "blk", [F.col("value")], ["r", "s"], next_of="value")


def column_pairs(columns: list[str]) -> list[tuple[str, str]]:
    if len(columns) < 2:
        raise ValueError("pairwise metrics need at least two columns")
    return list(combinations(columns, 2))


def smoothed_kl(cells: DataFrame, key: list[str], total_cells: int | None, smoothing: float) -> DataFrame:
    """KL(real || synthetic) per key over smoothed cell shares.

    ``total_cells`` counts empty cells as well; None means observed cells only.
    """
    t = with_totals(cells, key)
    n = F.lit(float(total_cells)) if total_cells else F.col("K_").cast("double")
    eps = F.lit(smoothing)
    p = lambda c: (c + eps) / (F.col("R_") + n * eps)
    q = lambda c: (c + eps) / (F.col("S_") + n * eps)
    term = p(F.col("r")) * F.ln(p(F.col("r")) / q(F.col("s")))
    zero = F.lit(0.0)
    empty = (n - F.first("K_")) * F.first(p(zero) * F.ln(p(zero) / q(zero))) if total_cells else zero
    return t.groupBy(*key).agg((F.sum(term) + empty).alias("kl"))


def as_metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")
