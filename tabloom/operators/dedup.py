"""Keep-first, per-group heads, tiered caps and row-set operations.

Heads filter ``row_number() <= n``, which Spark turns into a per-task limit
before the shuffle: a hot group sends at most n rows per task, never all its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.order import exact_order_statistics, top_rows
from tabloom.functions.scalar import col
from tabloom.session import checkpoint

HEAD_LIMIT = 1000  # largest n that Spark limits before the shuffle (its default threshold)
HEAD_SALTS = 64


def _ordering(order: list[str | Column]) -> list[Column]:
    return [col(o) for o in order]


def group_head(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """First ``n`` rows of every group in the given order."""
    by = _ordering(order)
    if n > HEAD_LIMIT:  # too many for the per-task limit: thin hot groups by salt first
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(HEAD_SALTS)))
        part = Window.partitionBy(*[col(k) for k in keys], "_salt").orderBy(*by)
        df = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return group_head(df, keys, order, 1)


def tiered_cap(df: DataFrame, subject: str, order: str, shares: list[float], caps: list[int]) -> DataFrame:
    """Cap rows per subject by tier of first appearance.

    Subjects are ordered by their smallest ``order`` value (unique per row).
    ``shares`` are the cumulative tier borders (0.3, 0.9); ``caps`` has one cap
    more. The borders are exact order statistics of the first appearances, so
    no global ranking is made.
    """
    # written once, as the borders take several passes over it
    first = checkpoint(df.groupBy(col(subject)).agg(F.min(col(order)).alias("_first")))
    borders: list[int] = []

    def ranks(subjects: int) -> list[int]:
        borders.extend(int(round(subjects * share)) for share in shares)  # halves go to even
        return [b for b in borders if b >= 1]

    cuts = exact_order_statistics(first, "_first", ranks)
    cap: Column | None = None
    for border, allowed in zip(borders, caps):
        if border >= 1:
            test = F.col("_first") <= F.lit(cuts[border])
            cap = F.when(test, allowed) if cap is None else cap.when(test, allowed)
    cap = F.lit(caps[-1]) if cap is None else cap.otherwise(caps[-1])

    w = Window.partitionBy(col(subject)).orderBy(col(order))
    ranked = group_head(df, [subject], [order], max(caps)).select(
        "*", F.row_number().over(w).alias("_rn"), F.first(col(order)).over(w).alias("_first"))
    return ranked.where(F.col("_rn") <= cap).drop("_rn", "_first")


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns]).distinct()


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the smallest order key at which each appears."""
    return df.groupBy(col(column).alias("value")).agg(F.min(col(order)).alias("first_order"))


def append_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def trim_to(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """Exactly the first ``n`` rows in order, which may have several keys and directions. Nulls come first in ascending order."""
    return top_rows(df, order, n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
