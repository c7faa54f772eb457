"""Scalar column expressions: rounding, clipping, draws, the normal distribution."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_53 = float(2**53)
EPSILON = float(2.0**-23)  # float32 machine epsilon, the bound used when clipping probabilities


def col(c: Column | str) -> Column:
    """A column by name; names with dots or spaces are quoted."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def half_even(c: Column, digits: int = 0) -> Column:
    """Round half to even as array libraries do: scale, ``rint``, scale back."""
    if digits == 0:
        return F.rint(c)
    scale = F.lit(10.0 ** abs(digits))
    return F.rint(c * scale) / scale if digits > 0 else F.rint(c / scale) * scale


def clip(c: Column, lo=None, hi=None) -> Column:
    """Limit to [lo, hi]; null stays null (``greatest``/``least`` would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def floor_mod_one(c: Column) -> Column:
    """``x mod 1`` in [0, 1) for either sign."""
    return c - F.floor(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (one missing value, not two)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([
        F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns
    ])


def keyed_uniform(keys: list[Column | str], seed: int) -> Column:
    """Uniform in (0, 1) that depends on the row key and seed only.

    Retries and other partition counts give the same draw.
    """
    h = F.xxhash64(*[col(k) for k in keys], F.lit(seed))
    return (F.pmod(h, F.lit(2**53)).cast("double") + F.lit(0.5)) / F.lit(TWO_53)


def uniform_int(u: Column, lo: Column, hi: Column) -> Column:
    """Uniform integer in [lo, hi) from a uniform ``u``."""
    return (lo + F.floor(u * (hi - lo))).cast("bigint")


# Rational approximation of the normal distribution function
# (Hart 1968, in the double-precision form of West 2005), highest power first.
PHI_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
PHI_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
PHI_SWITCH = 7.07106781186547
SQRT_TWO_PI = 2.506628274631

# Rational approximation of the inverse (Wichura 1988, AS 241), lowest power first.
PPF_CENTRE_NUMERATOR = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
PPF_CENTRE_DENOMINATOR = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
PPF_MIDDLE_NUMERATOR = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
PPF_MIDDLE_DENOMINATOR = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
PPF_TAIL_NUMERATOR = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
PPF_TAIL_DENOMINATOR = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def _poly(x: Column, coefficients) -> Column:
    first, *rest = coefficients
    return reduce(lambda acc, k: acc * x + F.lit(k), rest, F.lit(first))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once instead of spelled out at each use."""
    return F.get(F.transform(F.array(value), body), 0)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function.

    Inputs are bound with ``let``, so the formula stays small however it is
    nested, filtered on or moved by the optimiser.
    """
    def value(v: Column) -> Column:
        def tail(a: Column) -> Column:
            near = F.exp(-a * a / 2) * _poly(a, PHI_NUMERATOR) / _poly(a, PHI_DENOMINATOR)
            far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / SQRT_TWO_PI
            return F.when(a > 37, F.lit(0.0)).when(a < PHI_SWITCH, near).otherwise(far)

        return let(let(F.abs(v), tail), lambda t: F.when(v > 0, 1 - t).when(v <= 0, t))

    return let(x.cast("double"), value)


def normal_ppf(p: Column) -> Column:
    """Inverse of :func:`normal_cdf` on (0, 1)."""
    def ratio(numerator, denominator):
        return lambda x: _poly(x, numerator[::-1]) / _poly(x, denominator[::-1])

    def value(v: Column) -> Column:
        q = v - 0.5
        centre = q * let(0.180625 - q * q, ratio(PPF_CENTRE_NUMERATOR, PPF_CENTRE_DENOMINATOR))

        def outer(depth: Column) -> Column:
            middle = let(depth - 1.6, ratio(PPF_MIDDLE_NUMERATOR, PPF_MIDDLE_DENOMINATOR))
            tail = let(depth - 5, ratio(PPF_TAIL_NUMERATOR, PPF_TAIL_DENOMINATOR))
            return F.signum(q) * F.when(depth <= 5, middle).otherwise(tail)

        return F.when(F.abs(q) <= 0.425, centre).otherwise(let(F.sqrt(-F.ln(F.least(v, 1 - v))), outer))

    return let(p.cast("double"), value)


def _poly_values(x: np.ndarray, coefficients) -> np.ndarray:
    out = np.full_like(x, coefficients[0])
    for k in coefficients[1:]:
        out *= x
        out += k
    return out


def normal_cdf_values(x: np.ndarray) -> np.ndarray:
    """:func:`normal_cdf` of an array, inside a task."""
    a = np.abs(x)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        bell = np.exp(-a * a / 2)
        tail = bell * _poly_values(a, PHI_NUMERATOR) / _poly_values(a, PHI_DENOMINATOR)
        far = a >= PHI_SWITCH
        if far.any():
            b = a[far]
            tail[far] = np.where(b > 37, 0.0, bell[far] / (b + 1 / (b + 2 / (b + 3 / (b + 4 / (b + 0.65))))) / SQRT_TWO_PI)
    return np.where(x > 0, 1 - tail, tail)


def normal_ppf_values(p: np.ndarray) -> np.ndarray:
    """:func:`normal_ppf` of an array, inside a task."""
    def ratio(x, numerator, denominator):
        return _poly_values(x, numerator[::-1]) / _poly_values(x, denominator[::-1])

    q = p - 0.5
    out = q * ratio(0.180625 - q * q, PPF_CENTRE_NUMERATOR, PPF_CENTRE_DENOMINATOR)
    outer = np.abs(q) > 0.425
    if outer.any():
        v = p[outer]
        with np.errstate(divide="ignore", invalid="ignore"):
            depth = np.sqrt(-np.log(np.minimum(v, 1 - v)))
            found = ratio(depth - 1.6, PPF_MIDDLE_NUMERATOR, PPF_MIDDLE_DENOMINATOR)
            deep = depth > 5
            if deep.any():
                found[deep] = ratio(depth[deep] - 5, PPF_TAIL_NUMERATOR, PPF_TAIL_DENOMINATOR)
        out[outer] = np.sign(q[outer]) * found
    return out


HASH_PRIMES = tuple(np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
HASH_SEED = 42


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * HASH_PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * HASH_PRIMES[2]
    return h ^ (h >> np.uint64(32))


def keyed_uniform_values(ids: np.ndarray, seeds: list[int]) -> np.ndarray:
    """:func:`keyed_uniform` of a bigint key, a column for each seed (of 32 bits), inside a task."""
    p1, p2, p3, p4, p5 = HASH_PRIMES
    with np.errstate(over="ignore"):
        h = np.uint64(HASH_SEED) + p5 + np.uint64(8)
        h = _rotated(h ^ (_rotated(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = _mixed(h) + p5 + np.uint64(4)
        out = np.empty((len(ids), len(seeds)))
        for j, seed in enumerate(seeds):
            if not -2**31 <= seed < 2**31:
                raise ValueError(f"seed {seed} has more than 32 bits")
            g = _mixed(_rotated(h ^ (np.uint64(seed % 2**32) * p1), 23) * p2 + p3)
            out[:, j] = ((g & np.uint64(2**53 - 1)).astype(float) + 0.5) / TWO_53
    return out


def with_normal_cdf(df: DataFrame, outputs: dict[str, Column | str]) -> DataFrame:
    return df.withColumns({out: normal_cdf(col(x)) for out, x in outputs.items()})


def with_normal_ppf(df: DataFrame, outputs: dict[str, Column | str]) -> DataFrame:
    return df.withColumns({out: normal_ppf(col(p)) for out, p in outputs.items()})


def lookup(c: Column, table: dict, default=None) -> Column:
    """CASE over a short literal mapping; null keys compare null-safe."""
    out = None
    for k, v in table.items():
        test = c.eqNullSafe(F.lit(k))
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def literal_array(values, dtype: str) -> Column:
    """A constant array. One text literal is split or parsed when the query is
    optimised, which plans far faster than one literal per element."""
    values = list(values)
    if dtype == "string":
        return F.from_json(F.lit(json.dumps(values)), "array<string>")
    if not values:
        return F.array().cast(f"array<{dtype}>")
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{dtype}>")
