"""Numeric, boolean, datetime, scaling and identity encoders (plain expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import clip, col, half_even
from tabloom.operators import dates
from tabloom.operators.encoder import ColumnEncoder, NullFill, append, register

MAX_DECIMALS = 14
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
NO_DIGITS = MAX_DECIMALS + 1


def decimals_needed(x: Column) -> Column:
    """Smallest number of decimals (0..14) that holds ``x`` exactly, else 15."""
    out = F.when(F.rint(x) == x, 0)
    for digits in range(1, MAX_DECIMALS + 1):
        out = out.when(half_even(x, digits) == x, digits)
    return out.otherwise(NO_DIGITS)


def trailing_zeros(x: Column) -> Column:
    """How many powers of ten divide a whole number; null for zero."""
    out = F.when((x == 0) | (F.rint(x) != x), F.lit(None).cast("int"))
    for power in range(1, 19):
        out = out.when(half_even(x, -power) != x, power - 1)
    return out.otherwise(18)


def rounding_aggs(c: Column) -> dict[str, Column]:
    x = c.cast("double")
    finite = F.when(F.abs(x) != F.lit(math.inf), x)
    return {"decimals": F.max(F.when(finite.isNotNull(), decimals_needed(finite))),
            "zeros": F.min(F.when(finite.isNotNull(), trailing_zeros(finite))),
            "largest": F.max(F.abs(finite))}


def rounding_digits(stats: dict) -> int | None:
    """Digits from the aggregates: decimals, or minus the common powers of ten."""
    if stats["decimals"] is None or stats["decimals"] == NO_DIGITS:
        return None
    if stats["decimals"] > 0:
        return stats["decimals"]
    if not stats["largest"]:
        return 0
    return -min(int(math.log10(stats["largest"])), stats["zeros"])


@register("numerical")
class NumericEncoder(ColumnEncoder):
    """Numbers to doubles with nulls handled; reverse clips, rounds and casts back.

    ``rounding``, ``min_value`` and ``max_value`` take a number, ``"auto"``
    (learn from the data) or None. Integer columns come back as nullable integers.
    """

    input_type = "numerical"

    def __init__(self, nan="mean", null_column=None, rounding=None, min_value=None, max_value=None, dtype=None):
        self.null = NullFill(nan, null_column)
        self.rounding, self.min_value, self.max_value, self.dtype = rounding, min_value, max_value, dtype
        self.digits = self.low = self.high = None

    def fit_aggs(self, c):
        out = self.null.aggs(c)
        if self.min_value == "auto":
            out["min"] = F.min(c)
        if self.max_value == "auto":
            out["max"] = F.max(c)
        if self.rounding == "auto":
            out.update(rounding_aggs(c))
        return out

    def finish(self, stats, dtype):
        self.dtype = self.dtype or dtype
        self.low = stats["min"] if self.min_value == "auto" else self.min_value
        self.high = stats["max"] if self.max_value == "auto" else self.max_value
        self.digits = rounding_digits(stats) if self.rounding == "auto" else self.rounding
        self.null.finish(stats)
        self.null.warn_if_irreversible()

    def extra_fit(self, df, column):
        if self.null.wants_mode(True):
            self.null.learn_mode(df, column)

    def get_output_types(self):
        return {**self.output_types, **({"is_null": "float"} if self.null.has_indicator else {})}

    @property
    def is_composition_identity(self):
        return not self.null.nulls or self.null.has_indicator

    def filled(self, c: Column) -> Column:
        x = c.cast("double")
        return self.null.fill_column(F.when(~F.isnan(x), x)).cast("double")

    def encode(self, df, column, prefix):
        out = append(df, self.filled(col(column)), f"{prefix}__value")
        return self.encode_flag(out, column, prefix)

    def encode_flag(self, df, column, prefix):
        if not self.null.has_indicator:
            return df
        x = col(column)
        if dict(df.dtypes)[column] in ("double", "float"):
            x = F.when(~F.isnan(x), x)
        return append(df, self.null.flag_column(x), f"{prefix}__is_null")

    def restored(self, value: Column, prefix: str) -> Column:
        """Clip, put nulls back, round half to even, cast to the original type."""
        flag = col(f"{prefix}__is_null") if self.null.has_indicator else None
        x = clip(value, self.low, self.high) if (self.low is not None or self.high is not None) else value
        x = self.null.restore(x, flag)
        if self.digits is not None or self.dtype in INTEGER_TYPES:
            x = half_even(x, self.digits or 0)
        return x.cast(self.dtype)

    def decode(self, df, prefix, column):
        return append(df, self.restored(col(f"{prefix}__value"), prefix), column)


@register("numerical_bounded")
class BoundedEncoder(NumericEncoder):
    """Reverse stays within the learnt minimum and maximum."""

    def __init__(self, nan="mean", null_column=None, dtype=None):
        super().__init__(nan, null_column, None, "auto", "auto", dtype)


@register("numerical_rounded")
class RoundedEncoder(NumericEncoder):
    """Reverse rounds to the learnt number of digits."""

    def __init__(self, nan="mean", null_column=None, dtype=None):
        super().__init__(nan, null_column, "auto", None, None, dtype)


@register("numerical_rounded_bounded")
class RoundedBoundedEncoder(NumericEncoder):
    """Reverse clips and rounds as learnt."""

    def __init__(self, nan="mean", null_column=None, dtype=None):
        super().__init__(nan, null_column, "auto", "auto", "auto", dtype)


@register("standard")
class StandardEncoder(ColumnEncoder):
    """(x - mean) / population standard deviation; a zero deviation counts as 1."""

    input_type = "numerical"

    def fit_aggs(self, c):
        x = c.cast("double")
        return {"mean": F.avg(x), "std": F.stddev_pop(x)}

    def finish(self, stats, dtype):
        self.mean, self.std, self.dtype = stats["mean"] or 0.0, stats["std"] or 1.0, dtype

    def encode(self, df, column, prefix):
        return append(df, (col(column).cast("double") - F.lit(self.mean)) / F.lit(self.std), f"{prefix}__value")

    def decode(self, df, prefix, column):
        x = col(f"{prefix}__value") * F.lit(self.std) + F.lit(self.mean)
        if self.dtype in INTEGER_TYPES:
            x = half_even(x)
        return append(df, x.cast(self.dtype), column)


@register("boolean")
class BooleanEncoder(ColumnEncoder):
    """Booleans to 0/1; null to -1 with an indicator."""

    input_type = "boolean"

    def __init__(self, nan=-1, null_column=None):
        self.null = NullFill(nan, null_column)

    def fit_aggs(self, c):
        return self.null.aggs(c.cast("double"))

    def finish(self, stats, dtype):
        self.null.finish(stats)

    def extra_fit(self, df, column):
        if self.null.wants_mode(True) and self.null.value is None:
            self.null.learn_mode(df.select(col(column).cast("double").alias(column)), column)

    def get_output_types(self):
        return {**self.output_types, **({"is_null": "float"} if self.null.has_indicator else {})}

    def encode(self, df, column, prefix):
        out = append(df, self.null.fill_column(col(column).cast("double")).cast("double"), f"{prefix}__value")
        return append(out, self.null.flag_column(col(column)), f"{prefix}__is_null") if self.null.has_indicator else out

    def decode(self, df, prefix, column):
        flag = col(f"{prefix}__is_null") if self.null.has_indicator else None
        x = self.null.restore(col(f"{prefix}__value"), flag)
        return append(df, clip(F.rint(x), 0.0, 1.0).cast("boolean"), column)


# The divider grows by these factors (to seconds, minutes, hours, days).
MICRO_LADDER = (1_000_000, 60, 60, 24)


def divider_candidates() -> list[int]:
    out, unit = [1], 1
    for factor in MICRO_LADDER:
        unit *= factor
        out.append(unit)
    return out


@register("datetime")
class DatetimeEncoder(ColumnEncoder):
    """Timestamps to microseconds since the epoch.

    ``strip_constant`` divides by the largest time unit that divides all
    fitted values; it is learnt once, in fit. ``datetime_format`` parses text.
    """

    input_type = "datetime"

    def __init__(self, nan="mean", null_column=None, strip_constant=False, datetime_format=None):
        self.null = NullFill(nan, null_column)
        self.strip_constant, self.datetime_format, self.divider = strip_constant, datetime_format, 1

    def _number(self, c: Column) -> Column:
        stamp = dates.parse_datetime(c, self.datetime_format) if self.datetime_format else c
        return dates.micros(stamp)

    def fit_aggs(self, c):
        m = self._number(c)
        out = self.null.aggs(m)
        if self.strip_constant:
            for i, unit in enumerate(divider_candidates()):
                out[f"unit{i}"] = F.bool_and(F.pmod(m, F.lit(unit)) == 0)
        return out

    def finish(self, stats, dtype):
        self.dtype = dtype
        if self.strip_constant:
            for i, unit in enumerate(divider_candidates()):
                if not stats[f"unit{i}"]:
                    break
                self.divider = unit
            if stats.get("mean") is not None:
                stats["mean"] = stats["mean"] / self.divider
        self.null.finish(stats)

    def extra_fit(self, df, column):
        if self.null.wants_mode(True) and self.null.value is None:
            scaled = F.floor(self._number(col(column)) / F.lit(self.divider))
            self.null.learn_mode(df.select(scaled.alias(column)), column)

    def get_output_types(self):
        return {**self.output_types, **({"is_null": "float"} if self.null.has_indicator else {})}

    @property
    def is_composition_identity(self):
        return not self.null.nulls or self.null.has_indicator

    def encode(self, df, column, prefix):
        m = self._number(col(column))
        if self.divider > 1:
            m = F.floor(m / F.lit(self.divider))
        out = append(df, self.null.fill_column(m.cast("double")), f"{prefix}__value")
        return append(out, self.null.flag_column(m), f"{prefix}__is_null") if self.null.has_indicator else out

    def decode(self, df, prefix, column):
        flag = col(f"{prefix}__is_null") if self.null.has_indicator else None
        x = self.null.restore(col(f"{prefix}__value"), flag)
        return append(df, dates.from_micros(F.rint(x).cast("bigint") * F.lit(self.divider)), column)


@register("datetime_rounded")
class DatetimeRoundedEncoder(DatetimeEncoder):
    def __init__(self, nan="mean", null_column=None, datetime_format=None):
        super().__init__(nan, null_column, True, datetime_format)


@register("identity")
class IdentityEncoder(ColumnEncoder):
    """The column unchanged, under its output name."""

    input_type = "any"

    def encode(self, df, column, prefix):
        return append(df, col(column), f"{prefix}__value")

    def decode(self, df, prefix, column):
        return append(df, col(f"{prefix}__value"), column)


@register("null")
class NullEncoder(ColumnEncoder):
    """Null handling on its own, for a column of any type."""

    input_type = "any"

    def __init__(self, fill=None, null_column=None):
        self.null = NullFill(fill, null_column)
        self.numeric = True

    def fit_aggs(self, c):
        self.numeric = self.source_type in (*INTEGER_TYPES, "double", "float")
        return self.null.aggs(c, self.numeric)

    def finish(self, stats, dtype):
        self.dtype = dtype
        self.null.finish(stats, self.numeric)
        self.null.warn_if_irreversible()

    def extra_fit(self, df, column):
        if self.null.wants_mode(self.numeric):
            self.null.learn_mode(df, column)

    def get_output_types(self):
        return {**self.output_types, **({"is_null": "float"} if self.null.has_indicator else {})}

    def encode(self, df, column, prefix):
        out = append(df, self.null.fill_column(col(column)), f"{prefix}__value")
        return append(out, self.null.flag_column(col(column)), f"{prefix}__is_null") if self.null.has_indicator else out

    def decode(self, df, prefix, column):
        flag = col(f"{prefix}__is_null") if self.null.has_indicator else None
        return append(df, self.null.restore(col(f"{prefix}__value"), flag), column)
