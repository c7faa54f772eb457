"""One-column test data as expressions over a row id.

``generate(spark, name, n)`` makes a table; ``column(name, ...)`` gives the
expression for any id column, so every generator also applies to an existing
table. Draws come from ``draw(salt)``, a uniform per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import keyed_uniform, literal_array, with_normal_ppf

Draw = Callable[[int], Column]

# Fixed values
NAMES = ["Alice", "Bob", "Charlie", "Dave", "Eve"]
MIXED = ["2022-01-01 00:00:00", "2022-01-01 06:30:00", "7", "42", "99", "3.5", "61.25", "0", "1", "2", "3", "4", "true", "false"]
BASE_TIME = "2022-01-01 00:00:00"
MAX_TIME = "2262-04-11 00:00:00"
INT_SPAN, INT_LOW = 4294967296.0, -2147483648
BIG_SCALE = 1e10
TRUE_SHARE, CONSTANT, OTHER = 0.3, 1234567, -7654321


def _pick(values: list[str], u: Column) -> Column:
    return F.get(literal_array(values, "string"), F.floor(u * len(values)).cast("int"))


def _later(unit: str, amount: Column) -> Column:
    return F.timestamp_add(unit, amount.cast("bigint"), F.lit(BASE_TIME).cast("timestamp_ntz"))


def _capped(unit: str, i: Column, unit_days: int) -> Column:
    """Equal gaps up to the last representable time, which repeats from there on."""
    top = F.lit(MAX_TIME).cast("timestamp_ntz")
    most = F.floor(F.date_diff(top, F.lit(BASE_TIME).cast("timestamp_ntz")) / unit_days)
    return _later(unit, F.least(i, most))


def _whole(u: Column) -> Column:
    return (F.floor(u * INT_SPAN) + INT_LOW).cast("bigint")


def _almost_constant(i: Column) -> Column:
    return F.when(i == 0, F.lit(OTHER)).otherwise(F.lit(CONSTANT)).cast("bigint")


@dataclass(frozen=True)
class Generator:
    kind: str
    value: Callable[[Column, Draw], Column]
    nulls: bool = False


_BASE: dict[str, tuple[str, Callable[[Column, Draw], Column], bool]] = {
    "random_boolean": ("boolean", lambda i, u: u(0) < 0.5, True),
    "random_skewed_boolean": ("boolean", lambda i, u: u(0) < TRUE_SHARE, True),
    "constant_boolean": ("boolean", lambda i, u: F.lit(True), True),
    "categorical_random_integer": ("categorical", lambda i, u: (1 + F.floor(u(0) * 5)).cast("bigint"), True),
    "random_string": ("categorical", lambda i, u: _pick(NAMES, u(0)), True),
    "random_mixed": ("categorical", lambda i, u: _pick(MIXED, u(0)), True),
    "single_integer": ("categorical", lambda i, u: F.lit(CONSTANT).cast("bigint"), True),
    "single_string": ("categorical", lambda i, u: F.lit(NAMES[0]), True),
    "unique_integer": ("categorical", lambda i, u: i.cast("bigint"), True),
    "unique_string": ("categorical", lambda i, u: i.cast("string"), True),
    "random_gap_datetime": ("datetime", lambda i, u: _later("MICROSECOND", F.floor(u(0) * 86_400_000_000.0)), True),
    "random_gap_seconds_datetime": ("datetime", lambda i, u: _later("MICROSECOND", F.floor(u(0) * 1_000_000.0)), False),
    "equal_gap_hours_datetime": ("datetime", lambda i, u: _later("HOUR", i), False),
    "equal_gap_days_datetime": ("datetime", lambda i, u: _capped("DAY", i, 1), False),
    "equal_gap_weeks_datetime": ("datetime", lambda i, u: _capped("WEEK", i, 7), False),
    "numerical_random_integer": ("numerical", lambda i, u: _whole(u(0)), True),
    "constant_integer": ("numerical", lambda i, u: F.lit(CONSTANT).cast("bigint"), True),
    "almost_constant_integer": ("numerical", lambda i, u: _almost_constant(i), True),
    "normal": ("numerical", lambda i, u: u(9), True),
    "big_normal": ("numerical", lambda i, u: u(9) * BIG_SCALE, True),
}

GENERATORS: dict[str, Generator] = {}
for _name, (_kind, _value, _with_nulls) in _BASE.items():
    GENERATORS[_name] = Generator(_kind, _value)
    if _with_nulls:
        GENERATORS[f"{_name}_nans"] = Generator(_kind, _value, True)


def by_type(kind: str) -> list[str]:
    return [n for n, g in GENERATORS.items() if g.kind == kind]


def add_column(df: DataFrame, name: str, key: str, draw: Draw | None = None, null_share: float = 0.3,
               seed: int = 0, out: str = "value") -> DataFrame:
    """Append a generated column to a table with a non-negative integer key."""
    g = GENERATORS[name]
    u = draw or (lambda salt: keyed_uniform([key], seed + salt))
    staged = df.withColumns({"_u0": u(0), "_u1": u(1)})
    if name.startswith(("normal", "big_normal")):
        staged = with_normal_ppf(staged, {"_u9": F.col("_u0")})  # draw 9 is the normal form of draw 0
    value = g.value(F.col(key), lambda salt: F.col(f"_u{salt}"))
    if g.nulls:
        value = F.when(F.col("_u1") >= null_share, value)
    return staged.withColumn(out, value).drop("_u0", "_u1", "_u9")


def generate(spark: SparkSession, name: str, rows: int, seed: int = 0, null_share: float = 0.3) -> DataFrame:
    """A one-column table of ``rows`` rows."""
    return add_column(spark.range(rows), name, "id", seed=seed, null_share=null_share).select("value")


def demo_columns(df: DataFrame, key: str, rows: int, null_share: float = 0.2, seed: int = 0,
                 dtypes: tuple[str, ...] = ("int", "float", "str", "datetime"), draw=None) -> DataFrame:
    """Columns ``0_int``, ``1_float``, ... for the rows of ``df``, each with exactly int(rows * share) nulls.

    The rows whose hash is among the smallest become null; the border is an
    exact order statistic, so no row is numbered. ``draw`` gives the uniforms,
    distinct for distinct rows, by their number.
    """
    from tabloom.functions.order import exact_order_statistics

    gaps = int(rows * null_share)
    make = {
        "int": lambda u: F.floor(u * 100).cast("double"),
        "float": lambda u: u * 100,
        "str": lambda u: _pick(["a", "b", "c", "d"], u),
        "datetime": lambda u: _later("DAY", F.floor(u * 3650)),
    }
    out = df
    for i, kind in enumerate(dtypes):
        lot = draw(100 + i) if draw else F.xxhash64(key, F.lit(seed + 100 + i))
        value = make[kind](draw(i) if draw else keyed_uniform([key], seed + i))
        if gaps:
            border = exact_order_statistics(df.select(lot.alias("lot")), "lot", [gaps])[gaps]
            value = F.when(lot > F.lit(border), value)
        out = out.withColumn(f"{i}_{kind}", value)
    return out


def demo_table(spark: SparkSession, rows: int = 10, nans: bool = True, seed: int = 0,
               dtypes: tuple[str, ...] = ("int", "float", "str", "datetime")) -> DataFrame:
    made = demo_columns(spark.range(rows), "id", rows, 0.2 if nans else 0.0, seed, dtypes)
    return made.drop("id")
