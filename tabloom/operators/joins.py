"""Inner equi-joins: natural, composite key, and dimension lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.skew import skew_join

# A dimension is broadcast if it has at most this many rows and, written as text, bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("the tables share no column to join on")
    return shared


def natural_join(left: DataFrame, right: DataFrame, balance: bool = False) -> DataFrame:
    """Inner join on all shared columns; ``balance`` spreads hot keys of either side."""
    on = shared_columns(left, right)
    return skew_join(left, right, on) if balance else left.join(right, on)


def composite_join(left: DataFrame, right: DataFrame, on: list[str], balance: bool = False) -> DataFrame:
    return skew_join(left, right, on) if balance else left.join(right, on)


def lookup_join(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Join to a dimension, broadcast only when its rows and bytes are proven few.

    A larger dimension takes the shuffled join with hot keys spread.
    """
    if is_small(dimension):
        return df.join(F.broadcast(dimension), on)
    return skew_join(df, dimension, on)


def is_small(df: DataFrame) -> bool:
    """Rows are counted up to the bound; only a table within it is measured."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    measured = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()["bytes"]
    return (measured or 0) <= BROADCAST_BYTES
