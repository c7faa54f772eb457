"""Projections, casts, filters and column-level checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalar import col


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_columns(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """Cast the listed columns; float to int truncates toward zero."""
    chosen = set(columns)
    return df.select([col(c).cast(to).alias(c) if c in chosen else col(c) for c in df.columns])


def cast_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Force the categorical role: the value becomes its text."""
    return cast_columns(df, columns, "string")


def columns_with_nulls(df: DataFrame) -> list[str]:
    """Columns holding a null (or NaN), found in one pass."""
    floats = (T.DoubleType, T.FloatType)
    tests = [
        F.bool_or(col(f.name).isNull() | F.isnan(col(f.name)) if isinstance(f.dataType, floats)
                  else col(f.name).isNull()).alias(str(i))
        for i, f in enumerate(df.schema.fields)
    ]
    row = df.agg(*tests).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds a null, the generator's precondition."""
    return df.drop(*columns_with_nulls(df))


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and order of ``like``; a missing column is an error."""
    missing = [c for c in like.columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing from the table to align: {missing}")
    return project(df, like.columns)


def rule_filter(df: DataFrame, rules: list[Column], combine: str = "all") -> DataFrame:
    """Keep rows that obey all (or any) of the rules; unknown counts as broken."""
    if combine not in ("all", "any"):
        raise ValueError("combine must be 'all' or 'any'")
    join = (lambda a, b: a & b) if combine == "all" else (lambda a, b: a | b)
    return df.where(reduce(join, rules))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows that break it, out of all rows, in a single pass."""
    broken = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.coalesce(r, F.lit(False))).alias(f"_r{i}") for i, r in enumerate(rules.values())],
    )
    items = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"_r{i}").alias("violations")) for i, name in enumerate(rules)
    ])
    return broken.select("rows", F.explode(items).alias("x")).select("x.rule", "x.violations", "rows")


def block_order(df: DataFrame, onehot_columns: list[str], continuous_columns: list[str],
                keep: list[str] = ()) -> DataFrame:
    """Model input order: one-hot blocks first, continuous columns last."""
    return df.select(*[col(c) for c in (*keep, *onehot_columns, *continuous_columns)])


def as_vector(df: DataFrame, columns: list[str], out: str = "features", keep: list[str] = ()) -> DataFrame:
    """The ordered columns as one float array per row."""
    return df.select(*[col(c) for c in keep], F.array(*[col(c).cast("float") for c in columns]).alias(out))


def category_widths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values per column (the one-hot widths), all columns together.

    Counting over (column, value) pairs lets every map task collapse its
    repeats first; only distinct values are shuffled.
    """
    items = F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in columns
    ])
    pairs = df.select(F.explode(items).alias("x")).select("x.*").where(F.col("value").isNotNull())
    return pairs.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("width"))
