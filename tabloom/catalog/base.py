"""Registration and the conventions shared by queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRIME = 1_000_003


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def given_u(key: Column | str, salt: int) -> Column:
    """A uniform in (0, 1) that Spark and SQL compute alike from a non-negative key."""
    k = F.pmod(col(key).cast("bigint"), F.lit(PRIME))
    return (F.pmod(k * 7919 + F.lit(salt * 104729), F.lit(PRIME)).cast("double") + 0.5) / F.lit(float(PRIME))


def sql_u(key: str, salt: int) -> str:
    return (f"((((({key}) % {PRIME}) * 7919 + {salt * 104729}) % {PRIME})::DOUBLE + 0.5::DOUBLE)"
            f" / {PRIME}::DOUBLE")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero removes the sign of a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def sql_r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def sql_half_even(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round_even({x}, 0)"
    s = f"{10 ** abs(digits)}::DOUBLE"
    return f"(round_even(({x}) * {s}, 0) / {s})" if digits > 0 else f"(round_even(({x}) / {s}, 0) * {s})"


# lineitem has no single unique key; these columns together are unique
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus", "l_linenumber"]
