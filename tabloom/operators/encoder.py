"""The contract of reversible column encoders, their registry, and shared fitting.

Fitting gathers bounded state: every encoder names aggregates, all of them run
in one pass over the table, and value counts (where needed) in one more.
Encoding and decoding are lazy, so they apply to batch tables and streams.
"""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import col

REGISTRY: dict[str, type["ColumnEncoder"]] = {}


class NotFittedError(Exception):
    """Raised when an encoder is used before it was fitted."""


def register(name: str):
    """Make an encoder class known by name (also for encoders from outside)."""
    def add(cls):
        REGISTRY[name] = cls
        return cls
    return add


def make(name: str, **options) -> "ColumnEncoder":
    if name not in REGISTRY:
        raise KeyError(f"unknown encoder {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


class ColumnEncoder(ABC):
    """One column to one or more outputs named ``<prefix>__<output>``.

    Subclasses set ``input_type`` and ``output_types`` and give the expressions.
    """

    input_type: str = ""
    output_types: dict[str, str] = {"value": "float"}
    transform_deterministic = True
    reverse_deterministic = True
    composition_identity = True

    value_counts = False  # whether ``extra_fit`` uses (value, n) of the column, null as a value
    fitted = False
    source_type = ""
    counts: DataFrame | None = None

    # fitting ---------------------------------------------------------------
    def fit_aggs(self, c: Column) -> dict[str, Column]:
        """Aggregates wanted from the shared pass, by name."""
        return {}

    def finish(self, stats: dict, dtype: str) -> None:
        """Take the aggregates' results."""

    def extra_fit(self, df: DataFrame, column: str) -> None:
        """Further jobs for state that plain aggregates cannot give."""

    def fit(self, df: DataFrame, column: str) -> "ColumnEncoder":
        fit_all(df, {column: self})
        return self

    # use -------------------------------------------------------------------
    def get_output_types(self) -> dict[str, str]:
        return dict(self.output_types)

    def output_columns(self, prefix: str) -> list[str]:
        return [f"{prefix}__{o}" for o in self.get_output_types()]

    def next_encoders(self) -> dict[str, "ColumnEncoder"]:
        """Encoders to apply to outputs that are not numeric yet."""
        return {}

    @property
    def is_composition_identity(self) -> bool:
        return self.composition_identity

    @abstractmethod
    def encode(self, df: DataFrame, column: str, prefix: str) -> DataFrame:
        """Append the output columns."""

    @abstractmethod
    def decode(self, df: DataFrame, prefix: str, column: str) -> DataFrame:
        """Append (or replace) ``column`` from the output columns."""

    def _need_fit(self) -> None:
        if not self.fitted:
            raise NotFittedError(f"{type(self).__name__} must be fitted first")

    def transform(self, df: DataFrame, column: str, drop: bool = True) -> DataFrame:
        """Encode one column; a table without it is returned unchanged."""
        self._need_fit()
        if column not in df.columns:
            return df
        out = self.encode(df, column, free_prefix(df, column, self))
        return out.drop(column) if drop else out

    def fit_transform(self, df: DataFrame, column: str, drop: bool = True) -> DataFrame:
        return self.fit(df, column).transform(df, column, drop)

    def reverse_transform(self, df: DataFrame, column: str, drop: bool = True, prefix: str | None = None) -> DataFrame:
        self._need_fit()
        prefix = prefix or column
        outputs = self.output_columns(prefix)
        if not set(outputs) <= set(df.columns):
            return df
        out = self.decode(df, prefix, column)
        return out.drop(*[o for o in outputs if o != column]) if drop else out


class FieldEncoder(ColumnEncoder):
    """Several columns to one or more outputs named ``<a#b#...>__<output>``.

    Columns come as a tuple of names; ``fit_aggs`` gets a tuple of columns and
    ``finish`` a tuple of types.
    """

    def transform(self, df: DataFrame, columns: tuple[str, ...], drop: bool = True) -> DataFrame:
        self._need_fit()
        if not set(columns) <= set(df.columns):
            return df
        out = self.encode(df, columns, free_prefix(df, columns, self))
        return out.drop(*columns) if drop else out

    def reverse_transform(self, df: DataFrame, columns: tuple[str, ...], drop: bool = True, prefix: str | None = None) -> DataFrame:
        return super().reverse_transform(df, columns, drop, prefix or field_prefix(columns))


def columns_of(field: str | tuple[str, ...]) -> tuple[str, ...]:
    return (field,) if isinstance(field, str) else tuple(field)


def field_prefix(field: str | tuple[str, ...]) -> str:
    """The name of a field: its column's, or its columns' with ``#`` between them."""
    return "#".join(columns_of(field))


def free_prefix(df: DataFrame, field: str | tuple[str, ...], encoder: ColumnEncoder) -> str:
    """The field's name, with ``#`` appended until no output name is taken."""
    prefix, taken = field_prefix(field), set(df.columns)
    while taken & set(encoder.output_columns(prefix)):
        prefix += "#"
    return prefix


def fit_all(df: DataFrame, encoders: dict) -> dict:
    """Fit the encoders of columns, or of fields of several columns.

    The aggregates of all share one pass, and so do the value counts of all
    columns that want them.
    """
    missing = [c for f in encoders for c in columns_of(f) if c not in df.columns]
    if missing:
        raise KeyError(f"columns to fit are not in the table: {missing}")
    types = dict(df.dtypes)

    def given(name: str) -> Column:
        return F.when(~F.isnan(col(name)), col(name)) if types[name] in ("double", "float") else col(name)

    def typed(field):
        return tuple(types[c] for c in field) if isinstance(field, tuple) else types[field]

    wanted, places = [], {}
    for i, (field, enc) in enumerate(encoders.items()):
        c = tuple(given(x) for x in field) if isinstance(field, tuple) else given(field)
        enc.source_type = typed(field)
        for key, agg in enc.fit_aggs(c).items():
            places[(field, key)] = len(wanted)
            wanted.append(agg.alias(f"a{i}_{key}"))
    row = df.agg(*wanted).first() if wanted else []
    for field, enc in encoders.items():
        enc.finish({k: row[p] for (f, k), p in places.items() if f == field}, typed(field))
    counted = [f for f, enc in encoders.items() if enc.value_counts]
    if len(counted) > 1:
        shared = count_all_values(df, counted)
        for f in counted:
            encoders[f].counts = shared.where(F.col("column") == f).select("value", "n")
    for field, enc in encoders.items():
        enc.extra_fit(df, field)
        enc.fitted, enc.counts = True, None
    return encoders


def count_all_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns, written once: their repeats collapse in the map tasks of one pass."""
    from tabloom.session import checkpoint

    items = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.explode(items).alias("x")).select("x.*")
    return checkpoint(rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def append(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.withColumn(name, column)


@dataclass
class NullFill:
    """Null handling shared by encoders.

    ``fill``: "mean", "mode", a constant, or None (mean for numbers, mode
    otherwise). ``indicator``: True, False, or None (only if nulls were seen).
    """

    fill: object = None
    indicator: bool | None = None
    value: object = None
    nulls: bool = False

    def aggs(self, c: Column, numeric: bool = True) -> dict[str, Column]:
        out = {"nulls": F.count_if(c.isNull()), "rows": F.count(F.lit(1))}
        if numeric and self.fill in (None, "mean"):
            out["mean"] = F.avg(c.cast("double"))
        return out

    def wants_mode(self, numeric: bool) -> bool:
        return self.fill == "mode" or (self.fill is None and not numeric)

    def finish(self, stats: dict, numeric: bool = True) -> None:
        self.nulls = stats["nulls"] > 0
        learnt = self.fill is None or self.fill in ("mean", "mode")
        if learnt and stats["nulls"] == stats["rows"]:
            self.value = 0
        elif not learnt:
            self.value = self.fill
        elif not self.wants_mode(numeric):
            self.value = stats["mean"]

    def learn_mode(self, df: DataFrame, column: str) -> None:
        """Most frequent value, the smallest on ties."""
        if self.value is None:
            self.value = mode_value(df, column)

    @property
    def has_indicator(self) -> bool:
        return self.nulls if self.indicator is None else self.indicator

    def fill_column(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(self.value)) if self.value is not None else c

    def warn_if_irreversible(self) -> None:
        if self.nulls and not self.has_indicator:
            warnings.warn("nulls are replaced by a value without an indicator, so equal values become null on reverse")

    def flag_column(self, c: Column) -> Column:
        return c.isNull().cast("double")

    def restore(self, value: Column, flag: Column | None) -> Column:
        if not self.nulls:
            return value
        gone = flag > 0.5 if self.has_indicator else value == F.lit(self.value)
        return F.when(~F.coalesce(gone, F.lit(False)), value)


def mode_value(df: DataFrame, column: str):
    row = (df.select(col(column).alias("v")).where(F.col("v").isNotNull()).groupBy("v").count()
           .orderBy(F.desc("count"), "v").first())
    return row["v"] if row else None
