"""Variational Gaussian mixture encoder for continuous columns.

Each column is first reduced to weighted points (count, sum, sum of squares per
bin of about equal numbers of rows) in one pass over the table; the iterative
fit then works on those points, one column per group, columns in parallel. A
group never holds more than ``BINS + 2 * RINGS`` rows whatever the size of the
table, and every row is in one of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.order import add_bucket, quantile_edges
from tabloom.functions.scalar import clip, col, keyed_uniform, let, literal_array
from tabloom.operators.encoder import append, fit_all, register
from tabloom.operators.categorical import OneHotEncoder
from tabloom.operators.numeric import NumericEncoder

BINS = 1_024
RINGS = 64  # doublings beyond the outermost edges
CORE = 0.01  # share of the rows at either end that the priors leave aside
STD_MULTIPLIER = 4
PROBABILITY_FLOOR = 1e-6
NORMAL_BOUND = 0.99
WEIGHT_PRIOR = 0.001
TOLERANCE = 1e-3
MAX_ROUNDS = 100  # of one ascent

POINT_SCHEMA = "column string, centre double, bin int, ring int, n double, sx double, sxx double"
FIT_SCHEMA = "column string, component int, weight double, mean double, std double, rounds int"


def binned_points(df: DataFrame, filled: dict[str, Column], bins: int = BINS) -> DataFrame:
    """(column, bin, n, sx, sxx) of every column, two passes in all.

    Bins hold about equal numbers of rows, so that a far value takes none of
    the others' resolution. Beyond the outermost edges they double in width,
    which keeps far values apart from the rows near the edge. The sums are taken
    around the median so that they stay accurate.
    """
    names = list(filled)
    values = df.select(*[c.cast("double").alias(f"_v{i}") for i, c in enumerate(filled.values())])
    edges = quantile_edges(values, values.columns, bins)
    items, placed = [], values
    for i, name in enumerate(names):
        cuts = edges[f"_v{i}"]
        if not cuts:  # no value at all
            continue
        placed = add_bucket(placed, f"_v{i}", cuts, f"_b{i}")
        x, centre = F.col(f"_v{i}"), cuts[len(cuts) // 2]
        step = (cuts[-1] - cuts[0]) / len(cuts) or abs(centre) or 1.0
        out = F.greatest(F.lit(cuts[0]) - x, x - F.lit(cuts[-1]), F.lit(0.0))
        ring = F.least(F.floor(F.log2(out / F.lit(step) + 1)), F.lit(RINGS)).cast("int")
        items.append(F.struct(F.lit(name).alias("column"), F.col(f"_b{i}").alias("bin"), ring.alias("ring"),
                              F.lit(centre).alias("centre"), (x - F.lit(centre)).alias("x")))
    if not items:
        return df.sparkSession.createDataFrame([], POINT_SCHEMA)
    x = placed.select(F.explode(F.array(*items)).alias("p")).select("p.*").where(F.col("x").isNotNull())
    return x.groupBy("column", "centre", "bin", "ring").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x, shift = x.astype(float).copy(), np.zeros_like(x, dtype=float)
    while (x < 6).any():
        low = x < 6
        shift[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def core_moments(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray) -> tuple[float, float]:
    """Mean and variance without the outermost ``CORE`` of the rows; of all rows if the rest does not vary."""
    order = np.argsort(sx / n)
    share = np.cumsum(n[order]) / n.sum()
    for keep in (order[(share > CORE) & (share - n[order] / n.sum() < 1 - CORE)], order):
        mean = sx[keep].sum() / n[keep].sum()
        var = sxx[keep].sum() / n[keep].sum() - mean**2
        if var > 1e-12 * max(1.0, mean**2):
            return mean, var
    return mean, 1e-12


def _gap(a, b, beta, mean, shape, rate, mean0: float, var0: float) -> float:
    """How far the fitted sticks and components are from their priors (the divergence that the bound subtracts)."""
    lg = np.vectorize(math.lgamma)
    sticks = (lg(a + b) - lg(a) - lg(b) - math.log(WEIGHT_PRIOR) + (a - 1) * _digamma(a)
              + (b - WEIGHT_PRIOR) * _digamma(b) + (1 + WEIGHT_PRIOR - a - b) * _digamma(a + b))
    means = 0.5 * (np.log(beta) + 1 / beta - 1 + shape / rate * (mean - mean0) ** 2)
    rate0 = 0.5 * var0
    spreads = ((shape - 0.5) * _digamma(shape) - lg(shape) + math.lgamma(0.5) + 0.5 * (np.log(rate) - math.log(rate0))
               + shape * (rate0 - rate) / rate)
    return float((sticks + means + spreads).sum())


def settle(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, resp: np.ndarray, mean0: float, var0: float) -> dict:
    """Coordinate ascent from the given responsibilities until the bound on the evidence of all rows settles."""
    x, second = sx / n, sxx / n
    previous, rounds = -math.inf, 0
    for rounds in range(1, MAX_ROUNDS + 1):
        resp = resp[:, np.argsort(-(resp.T @ n), kind="stable")]  # the prior expects the largest first
        nk = resp.T @ n + 1e-10
        xk = (resp.T @ sx) / nk
        sk = np.maximum((resp.T @ sxx) / nk - xk**2, 0.0) + 1e-6 * var0
        later = np.concatenate([np.cumsum(nk[::-1])[::-1][1:], [0.0]])
        a_stick, b_stick = 1.0 + nk, WEIGHT_PRIOR + later
        beta = 1.0 + nk
        mean = (mean0 + nk * xk) / beta
        shape = 0.5 * (1.0 + nk)
        rate = 0.5 * (var0 + nk * sk + nk / beta * (xk - mean0) ** 2)
        both = _digamma(a_stick + b_stick)
        log_stick = _digamma(a_stick) - both
        log_rest = _digamma(b_stick) - both
        log_weight = log_stick + np.concatenate([[0.0], np.cumsum(log_rest)[:-1]])
        log_precision = _digamma(shape) - np.log(rate)
        # within-bin spread enters through the second moment of the bin
        quad = second[:, None] - 2 * x[:, None] * mean[None, :] + mean[None, :] ** 2
        logp = log_weight + 0.5 * (log_precision - 1 / beta - math.log(2 * math.pi)) - 0.5 * (shape / rate) * quad
        top = logp.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        resp = np.exp(logp - norm[:, None])
        bound = float((n * norm).sum()) - _gap(a_stick, b_stick, beta, mean, shape, rate, mean0, var0)
        if abs(bound - previous) < TOLERANCE:
            break
        previous = bound
    stick = a_stick / (a_stick + b_stick)
    weight = stick * np.concatenate([[1.0], np.cumprod(1 - stick)[:-1]])
    return {"bound": bound, "resp": resp, "weight": weight / weight.sum(), "mean": mean, "std": np.sqrt(rate / shape),
            "rounds": rounds}


def fit_points(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray, components: int) -> tuple:
    """Mean-field fit of a stick-breaking 1-D mixture to weighted points.

    Normal-Gamma components and Beta sticks (Bishop 2006, ch. 10; Blei and
    Jordan 2006). Ascent alone is slow to empty superfluous components, so
    neighbours in the order of their means are merged as long as that raises the
    bound. Returns weights, means, standard deviations and rounds.
    """
    total, x = n.sum(), sx / n
    mean0, var0 = core_moments(n, sx, sxx)
    order = np.argsort(x)
    share = np.cumsum(n[order]) / total
    starts = x[order][np.minimum(np.searchsorted(share, (np.arange(components) + 0.5) / components), len(x) - 1)]
    best = settle(n, sx, sxx, np.eye(components)[np.abs(x[:, None] - starts[None, :]).argmin(axis=1)], mean0, var0)
    rounds, merged = best["rounds"], True
    while merged:
        merged = False
        live = [k for k in np.argsort(best["mean"]) if best["weight"][k] * total > 1e-3]
        gaps = [abs(best["mean"][a] - best["mean"][b]) / (best["std"][a] + best["std"][b]) for a, b in zip(live, live[1:])]
        for i in np.argsort(gaps, kind="stable"):  # the most alike first
            a, b = live[i], live[i + 1]
            resp = best["resp"].copy()
            resp[:, a] += resp[:, b]
            resp[:, b] = 0.0
            tried = settle(n, sx, sxx, resp, mean0, var0)
            rounds += tried["rounds"]
            if tried["bound"] > best["bound"]:
                best, merged = tried, True
                break
    return best["weight"], best["mean"], best["std"], rounds


def _fit_group(components: int):
    def fit(key, points: pd.DataFrame) -> pd.DataFrame:
        centre = float(points["centre"].iloc[0])
        points = points.sort_values(["bin", "ring"])
        scale = math.sqrt(core_moments(*(points[c].to_numpy() for c in ("n", "sx", "sxx")))[1])
        n, sx, sxx = points.n.to_numpy(), points.sx.to_numpy() / scale, points.sxx.to_numpy() / scale**2
        weight, mean, std, rounds = fit_points(n, sx, sxx, components)
        return pd.DataFrame({
            "column": key[0], "component": np.arange(components, dtype="int32"), "weight": weight,
            "mean": mean * scale + centre, "std": std * scale, "rounds": np.int32(rounds)})
    return fit


def fit_mixtures(df: DataFrame, filled: dict[str, Column], components: int = 10) -> DataFrame:
    """Mixture parameters of all columns: one row per (column, component)."""
    points = binned_points(df, filled)
    return points.groupBy("column").applyInPandas(_fit_group(components), FIT_SCHEMA)


@register("mixture")
class MixtureEncoder(NumericEncoder):
    """Continuous value to (position inside its component, component).

    ``selection="sample"`` draws the component from the posterior (from a hash
    of ``keys`` and ``seed``, or the given uniform ``u``), ``"argmax"`` takes the likeliest.
    """

    output_types = {"normalized": "float", "component": "categorical"}
    composition_identity = False

    def __init__(self, nan="mean", null_column=None, rounding=None, min_value=None, max_value=None, dtype=None,
                 max_clusters: int = 10, weight_threshold: float = 0.005, selection: str = "sample",
                 keys: list[str] | None = None, seed: int = 0, u: Column | None = None):
        super().__init__(nan, null_column, rounding, min_value, max_value, dtype)
        self.u = u
        self.max_clusters, self.weight_threshold = max_clusters, weight_threshold
        self.selection, self.keys, self.seed = selection, keys, seed
        self.transform_deterministic = selection == "argmax"
        self.parameters = None

    @property
    def is_composition_identity(self):
        return False

    def extra_fit(self, df, column):
        super().extra_fit(df, column)
        if self.parameters is None:
            rows = fit_mixtures(df, {column: self.filled(col(column))}, self.max_clusters).collect()
            self.set_parameters([(r["weight"], r["mean"], r["std"]) for r in sorted(rows, key=lambda r: r["component"])])

    def set_parameters(self, parameters: list[tuple[float, float, float]]) -> None:
        """(weight, mean, std) of all components; those above the threshold are used."""
        self.parameters = parameters
        self.valid = [p for p in parameters if p[0] > self.weight_threshold]

    def with_parameters(self, parameters) -> "MixtureEncoder":
        self.set_parameters(parameters)
        return self

    def next_encoders(self):
        return {"component": OneHotEncoder(categories=list(range(len(self.valid))))}

    def choose(self, x: Column, u: Column | None) -> Column:
        """Component of ``x``: the likeliest, or the one a uniform draw falls into.

        The posterior over all components is restricted to the valid ones and
        raised by a small floor. Written with lambdas over a literal parameter
        array, so its size does not grow with the number of components.
        """
        keep = [i for i, p in enumerate(self.parameters) if p[0] > self.weight_threshold]
        terms = F.array(*[
            F.struct(F.lit(math.log(max(w, 1e-300)) - math.log(s)).alias("c"), F.lit(m).alias("m"),
                     F.lit(1 / (2 * s * s)).alias("h")) for w, m, s in self.parameters])
        logs = F.transform(terms, lambda p: p["c"] - (x - p["m"]) * (x - p["m"]) * p["h"])

        def pick(dense: Column) -> Column:
            total = F.aggregate(dense, F.lit(0.0), lambda a, b: a + b)
            chances = let(total, lambda t: F.transform(
                F.array(*[F.lit(i) for i in keep]), lambda i: F.get(dense, i) / t + F.lit(PROBABILITY_FLOOR)))
            return let(chances, self._argmax if u is None else lambda p: self._draw(p, u))

        return let(logs, lambda v: let(F.array_max(v), lambda top: let(
            F.transform(v, lambda e: F.exp(e - top)), pick)))

    @staticmethod
    def _argmax(p: Column) -> Column:
        return (F.array_position(p, F.array_max(p)) - 1).cast("int")

    @staticmethod
    def _draw(p: Column, u: Column) -> Column:
        """How many running sums stay below the draw times the total."""
        target = u * F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
        walked = let(target, lambda t: F.aggregate(p, start, lambda acc, e: F.struct(
            (acc["s"] + e).alias("s"), (acc["k"] + F.when(acc["s"] + e < t, 1).otherwise(0)).alias("k")))["k"])
        return F.least(walked, F.size(p) - 1)

    def draw(self) -> Column:
        if self.u is not None:
            return self.u
        return keyed_uniform(self.keys, self.seed) if self.keys else F.rand(self.seed)

    def encode(self, df, column, prefix):
        staged = df.withColumns({"_x": self.filled(col(column))} | (
            {} if self.selection == "argmax" else {"_u": self.draw()}))
        u = None if self.selection == "argmax" else F.col("_u")
        out = staged.withColumn(f"{prefix}__component", self.choose(F.col("_x"), u))
        means, stds = literal_array([m for _, m, _ in self.valid], "double"), literal_array([s for *_, s in self.valid], "double")
        k = col(f"{prefix}__component")
        scaled = (F.col("_x") - F.get(means, k)) / (STD_MULTIPLIER * F.get(stds, k))
        out = out.withColumn(f"{prefix}__normalized", clip(scaled, -NORMAL_BOUND, NORMAL_BOUND)).drop("_x", "_u")
        return self.encode_flag(out, column, prefix)

    def decode(self, df, prefix, column):
        means, stds = literal_array([m for _, m, _ in self.valid], "double"), literal_array([s for *_, s in self.valid], "double")
        k = col(f"{prefix}__component").cast("int")
        x = clip(col(f"{prefix}__normalized"), -1.0, 1.0) * STD_MULTIPLIER * F.get(stds, k) + F.get(means, k)
        return append(df, self.restored(x, prefix), column)


def fit_mixture_encoders(df: DataFrame, encoders: dict[str, MixtureEncoder]) -> dict[str, MixtureEncoder]:
    """Fit several mixture columns together: shared aggregates, one binned pass, one grouped fit."""
    holders = {}
    for name, enc in encoders.items():
        helper = NumericEncoder(enc.null.fill, enc.null.indicator, enc.rounding, enc.min_value, enc.max_value, enc.dtype)
        holders[name] = helper
    fit_all(df, holders)
    components = max(e.max_clusters for e in encoders.values())
    rows = fit_mixtures(df, {n: h.filled(col(n)) for n, h in holders.items()}, components).collect()
    for name, enc in encoders.items():
        found = sorted((r for r in rows if r["column"] == name), key=lambda r: r["component"])
        enc.set_parameters([(r["weight"], r["mean"], r["std"]) for r in found])
        h = holders[name]
        enc.null, enc.low, enc.high, enc.digits, enc.dtype, enc.fitted = h.null, h.low, h.high, h.digits, h.dtype, True
    return encoders
