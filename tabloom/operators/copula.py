"""Copula encoder: a column's marginal distribution to a standard normal and back.

The Gaussian marginal is closed form. Other families are tabulated from moments
on a grid of about ``GRID`` points, most at quantiles of the column, the rest in
equal steps and in rings beyond the quantiles, and applied as grid search plus linear
interpolation, which stays inside the JVM. So a far value takes no resolution
from the other rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.order import add_bucket
from tabloom.functions.scalar import EPSILON, clip, col, let, literal_array, with_normal_cdf, with_normal_ppf
from tabloom.operators.encoder import append, register
from tabloom.operators.mixture import binned_points
from tabloom.operators.numeric import NumericEncoder

GRID = 1024
KDE_BINS = 512
KDE_CELLS = 1 << 20  # grid points times bins handled at once
RINGS = 64  # doublings beyond the outermost quantiles
QUANTILES = 200
CORE = 2  # quantiles at either end that the core leaves aside

# The families, whether each is parametric, and its support.
FAMILIES = {
    "gaussian": ("parametric", "unbounded"),
    "gamma": ("parametric", "semi_bounded"),
    "beta": ("parametric", "bounded"),
    "student_t": ("parametric", "unbounded"),
    "gaussian_kde": ("non_parametric", "unbounded"),
    "truncated_gaussian": ("parametric", "bounded"),
}
SELECTIONS = {
    "univariate": (None, None),
    "parametric": ("parametric", None),
    "bounded": (None, "bounded"),
    "semi_bounded": (None, "semi_bounded"),
    "parametric_bounded": ("parametric", "bounded"),
    "parametric_semi_bounded": ("parametric", "semi_bounded"),
}


def candidates(selection: str) -> list[str]:
    if selection in FAMILIES:
        return [selection]
    if selection not in SELECTIONS:
        raise TypeError(f"invalid distribution: {selection!r}")
    kind, support = SELECTIONS[selection]
    return [f for f, (k, s) in FAMILIES.items() if kind in (None, k) and support in (None, s)]


def moment_aggs(c: Column) -> dict[str, Column]:
    x = c.cast("double")
    return {"m_mean": F.avg(x), "m_var": F.var_pop(x), "m_kurt": F.kurtosis(x),
            "m_min": F.min(x), "m_max": F.max(x), "m_n": F.count(x)}


def family_parameters(family: str, m: dict) -> dict[str, float]:
    """Parameters by the method of moments."""
    mean, var, low, high = m["m_mean"], max(m["m_var"], 1e-300), m["m_min"], m["m_max"]
    if family == "gaussian":
        return {"mean": mean, "std": math.sqrt(var)}
    if family == "gamma":
        above = max(mean - low, 1e-12)
        return {"shape": above**2 / var, "loc": low, "scale": var / above}
    if family == "beta":
        span = (high - low) or 1.0
        mu, v = (mean - low) / span, var / span**2
        common = max(mu * (1 - mu) / v - 1, 1e-6) if v > 0 else 1e6
        return {"a": max(mu * common, 1e-3), "b": max((1 - mu) * common, 1e-3), "loc": low, "scale": span}
    if family == "student_t":
        excess = m["m_kurt"] or 0.0
        dof = 4 + 6 / excess if excess > 0.06 else 100.0
        return {"dof": dof, "loc": mean, "scale": math.sqrt(var * (dof - 2) / dof)}
    if family == "truncated_gaussian":
        return {"mean": mean, "std": math.sqrt(var), "min": low, "max": high}
    return {"bandwidth": min(math.sqrt(var), core_spread(m) or math.inf) * max(m["m_n"], 1) ** -0.2}


def core_spread(m: dict) -> float:
    """Standard deviation of the column's core: of its quantiles without the outermost; 0 if they do not vary or are not given."""
    q = np.array(m.get("m_q") or [])
    inner = q[CORE:len(q) - CORE]
    return float(inner.std()) if len(inner) else 0.0


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def points(left: float, right: float, m: dict) -> np.ndarray:
    """Grid points of a table: equal steps, the column's quantiles with steps between them, and rings beyond these."""
    q = np.unique(np.array(m.get("m_q") or [], dtype=float))
    parts = [np.linspace(left, right, GRID // 4 if len(q) > 1 else GRID)]
    if len(q) > 1:
        steps = max(1, 3 * GRID // 4 // (len(q) - 1))
        parts.append(np.interp(np.arange((len(q) - 1) * steps + 1) / steps, np.arange(len(q)), q))
        spread = core_spread(m) or (q[-1] - q[0]) / len(q)
        rings = spread / 64 * 2.0 ** np.arange(RINGS)
        parts += [q[0] - rings, q[-1] + rings]
    x = np.unique(np.concatenate(parts))
    x = x[(x >= left) & (x <= right)]
    return x[np.concatenate([[True], np.diff(x) > 1e-12 * np.maximum(1e-300, np.abs(x[1:]))])] if len(x) > 1 else x


def tabulate(family: str, p: dict, m: dict, histogram: tuple | None = None) -> tuple[list[float], list[float]]:
    """Grid of (x, CDF) for a family, by closed form or trapezoid sums of the density."""
    low, high = m["m_min"], m["m_max"]
    sd = math.sqrt(max(m["m_var"], 1e-300))
    inside = family in ("beta", "truncated_gaussian")
    left = low if inside or family == "gamma" else low - 4 * sd
    x = points(left, high if inside else high + 4 * sd, m)
    if family in ("gaussian", "truncated_gaussian"):
        cdf = _phi((x - p["mean"]) / p["std"])
    elif family == "gaussian_kde":
        centre, weight = histogram
        h = p["bandwidth"]
        part = max(1, KDE_CELLS // len(centre))
        cdf = np.concatenate([_phi((x[a:a + part, None] - centre[None, :]) / h) @ weight for a in range(0, len(x), part)]) / weight.sum()
    else:
        # half-step offsets keep the density finite at the support's ends
        t = np.unique(np.interp(np.arange(8 * (len(x) - 1) + 1) / 8, np.arange(len(x)), x))
        mid = (t[:-1] + t[1:]) / 2
        if family == "gamma":
            y = (mid - p["loc"]) / p["scale"]
            logpdf = (p["shape"] - 1) * np.log(y) - y
        elif family == "beta":
            y = (mid - p["loc"]) / p["scale"]
            logpdf = (p["a"] - 1) * np.log(y) + (p["b"] - 1) * np.log1p(-y)
        else:
            y = (mid - p["loc"]) / p["scale"]
            logpdf = -(p["dof"] + 1) / 2 * np.log1p(y * y / p["dof"])
        mass = np.exp(logpdf - logpdf.max()) * np.diff(t)
        edge = np.concatenate([[0.0], np.cumsum(mass)])
        cdf = np.interp(x, t, edge)
    cdf = cdf - cdf[0] if family not in ("gaussian", "gaussian_kde") else cdf
    cdf = cdf / cdf[-1] if family not in ("gaussian", "gaussian_kde") and cdf[-1] > 0 else cdf
    rising = np.concatenate([[True], np.diff(np.maximum.accumulate(cdf)) > 1e-15])
    return x[rising].tolist(), np.maximum.accumulate(cdf)[rising].tolist()


def histogram_points(df: DataFrame, x: Column) -> tuple[np.ndarray, np.ndarray]:
    """Bin means and counts of a column in bins of equal numbers of rows, with rings that double in width beyond them."""
    rows = binned_points(df, {"x": x}, KDE_BINS).orderBy("bin", "ring").collect()  # KDE_BINS + 2 * RINGS at most
    return np.array([r["centre"] + r["sx"] / r["n"] for r in rows]), np.array([r["n"] for r in rows])


def interpolate(df: DataFrame, value: str, xs: list[float], ys: list[float], out: str) -> DataFrame:
    """Piecewise linear y(x), flat outside the grid."""
    found = add_bucket(df, value, xs[1:-1], "_g")
    ax, ay = literal_array(xs, "double"), literal_array(ys, "double")

    def line(at: Column) -> Column:
        x0, x1, y0, y1 = F.get(ax, at["g"]), F.get(ax, at["g"] + 1), F.get(ay, at["g"]), F.get(ay, at["g"] + 1)
        return F.when(at["v"].isNotNull(), y0 + (at["v"] - x0) / (x1 - x0) * (y1 - y0))

    place = F.struct(F.col("_g").alias("g"), clip(col(value), xs[0], xs[-1]).alias("v"))
    return found.withColumn(out, let(place, line)).drop("_g")


@register("gaussian_copula")
class CopulaEncoder(NumericEncoder):
    """z = inverse normal of the marginal CDF; reverse applies the marginal quantile.

    ``distribution`` is a family or a selection such as "parametric"; with
    several candidates the smallest KS distance to the sketch quantiles wins.
    """

    def __init__(self, nan="mean", null_column=None, rounding=None, min_value=None, max_value=None, dtype=None,
                 distribution: str = "parametric"):
        super().__init__(nan, null_column, rounding, min_value, max_value, dtype)
        self.options = candidates(distribution)

    def fit_aggs(self, c):
        wanted = {**super().fit_aggs(c), **moment_aggs(c)}
        if self.options == ["gaussian"]:  # closed form and no other to compare it with
            return wanted
        return {**wanted, "m_q": F.percentile_approx(c.cast("double"), [(i + 0.5) / QUANTILES for i in range(QUANTILES)], 10_000)}

    def finish(self, stats, dtype):
        super().finish(stats, dtype)
        self.moments = self._with_fill(stats)

    def _with_fill(self, stats: dict) -> dict:
        """Moments of the filled column: filling by a value shrinks the variance."""
        m = {k: v for k, v in stats.items() if k.startswith("m_")}
        if m["m_n"] == 0:
            return {**m, "m_mean": 0.0, "m_var": 0.0, "m_min": 0.0, "m_max": 0.0, "m_kurt": 0.0}
        gaps, fill = stats["nulls"], self.null.value
        if gaps and isinstance(fill, (int, float)):
            n, k, total = m["m_n"], gaps, m["m_n"] + gaps
            mean = (n * m["m_mean"] + k * fill) / total
            var = (n * (m["m_var"] + (m["m_mean"] - mean) ** 2) + k * (fill - mean) ** 2) / total
            m.update(m_mean=mean, m_var=var, m_n=total, m_min=min(m["m_min"], fill), m_max=max(m["m_max"], fill))
        return m

    def extra_fit(self, df, column):
        super().extra_fit(df, column)
        m = self.moments
        fits = {}
        for family in self.options:
            p = family_parameters(family, m)
            hist = histogram_points(df, self.filled(col(column))) if family == "gaussian_kde" else None
            fits[family] = (p, tabulate(family, p, m, hist))
        self.distances = {f: self._distance(grid) for f, (_, grid) in fits.items()} if m.get("m_q") else {}
        self.family = min(self.distances, key=self.distances.get) if self.distances else self.options[0]
        self.parameters, self.grid = fits[self.family]

    def _distance(self, grid) -> float:
        """KS distance between a tabulated CDF and the sketch quantiles."""
        q = np.array(self.moments["m_q"] or [0.0])
        wanted = (np.arange(len(q)) + 0.5) / len(q)
        return float(np.abs(np.interp(q, *grid, left=0.0, right=1.0) - wanted).max())

    def standardised(self, c: Column) -> Column:
        """The filled column by the Gaussian family's mean and deviation."""
        return (self.filled(c) - F.lit(self.parameters["mean"])) / F.lit(self.parameters["std"] or 1.0)

    def with_uniform(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """Append the marginal CDF of the filled column, kept off 0 and 1."""
        made = df.withColumn("_x", self.filled(col(column)))
        if self.family == "gaussian":
            made = with_normal_cdf(made, {"_u": self.standardised(col(column))})
        else:
            made = interpolate(made, "_x", *self.grid, "_u")
        return made.withColumn(out, clip(F.col("_u"), EPSILON, 1 - EPSILON)).drop("_x", "_u")

    def encode(self, df, column, prefix):
        out = self.with_uniform(df, column, f"{prefix}__value")
        out = with_normal_ppf(out, {f"{prefix}__value": col(f"{prefix}__value")})
        return self.encode_flag(out, column, prefix)

    def decode(self, df, prefix, column):
        z = col(f"{prefix}__value")
        if self.family == "gaussian":
            return append(df, self.restored(z * F.lit(self.parameters["std"]) + F.lit(self.parameters["mean"]), prefix), column)
        xs, us = self.grid
        found = interpolate(with_normal_cdf(df, {"_u": z}), "_u", us, xs, "_x")
        return append(found, self.restored(F.col("_x"), prefix), column).drop("_u", "_x")


def marginal_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of moments per column, all columns in one pass."""
    aggs = [a.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, a in moment_aggs(col(c)).items()]
    wide = df.agg(*aggs)
    keys = list(moment_aggs(F.lit(0.0)))
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{i}").alias(k) for k in keys])
                      for i, c in enumerate(columns)])
    return wide.select(F.explode(items).alias("x")).select("x.*")
