"""Gaussian copula: marginals per column, one correlation matrix, linear sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.fidelity.pairwise import correlation
from tabloom.functions.scalar import EPSILON, clip, col, keyed_uniform, keyed_uniform_values, normal_cdf_values, normal_ppf_values
from tabloom.functions.sums import numbers
from tabloom.operators.categorical import CategoricalEncoder, attach
from tabloom.operators.copula import CopulaEncoder
from tabloom.operators.encoder import fit_all
from tabloom.roles import ColumnRoles


class GaussianCopula:
    """Fit on a table, then sample any number of rows lazily.

    Continuous columns use ``distribution`` marginals; categories use their
    frequency intervals, inside which a row's position is drawn from its keys,
    however many categories there are; so a table with categories needs keys.
    """

    def __init__(self, roles: ColumnRoles, distribution: str = "gaussian", keys: list[str] | None = None, seed: int = 0):
        if roles.categorical and not keys:
            raise ValueError("keys are required, as a category's rows are drawn inside its interval by their keys")
        self.roles, self.distribution, self.keys, self.seed = roles, distribution, keys or [], seed

    def fit(self, df: DataFrame) -> "GaussianCopula":
        self.columns = [*self.roles.categorical, *self.roles.continuous]
        self.encoders = {c: CategoricalEncoder(lookup_by="interval", clip_values=True) for c in self.roles.categorical}
        self.encoders |= {c: CopulaEncoder(distribution=self.distribution, min_value="auto", max_value="auto", rounding="auto")
                          for c in self.roles.continuous}
        fit_all(df, self.encoders)
        m = len(self.columns)
        self.matrix = np.eye(m)
        place = {c: i for i, c in enumerate(self.columns)}
        for r in correlation(self.normal_scores(df), self.columns).collect():
            if r["corr"] is not None:
                self.matrix[place[r["column_a"]], place[r["column_b"]]] = r["corr"]
        values, vectors = np.linalg.eigh(self.matrix)
        positive = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
        scale = np.sqrt(np.diag(positive))
        self.factor = np.linalg.cholesky(positive / np.outer(scale, scale))
        return self

    def normal_scores(self, df: DataFrame) -> DataFrame:
        """Every column as its standard normal score."""
        out = df
        for i, c in enumerate(self.roles.categorical):
            inside = keyed_uniform(self.keys, self.seed + 1000 + i) - 0.5
            out = attach(out, c, self.encoders[c].cats, ["mid", "std"], [f"{c}__value", f"{c}__std"])
            drawn = col(f"{c}__value") + inside * 6 * col(f"{c}__std")  # the interval is six of its stds wide
            out = out.withColumn(f"{c}__value", clip(drawn, EPSILON, 1 - EPSILON)).drop(f"{c}__std")
        linear = set()  # columns whose uniform is the distribution function of a standard normal
        for c in self.roles.continuous:
            e = self.encoders[c]
            if e.family == "gaussian":
                linear.add(c)
                out = out.withColumn(f"{c}__value", e.standardised(col(c)))
            else:
                out = e.with_uniform(out, c, f"{c}__value")
        bent = [c in linear for c in self.columns]

        def scores(batches):
            for batch in batches:
                made = []
                for i, z in enumerate(bent):
                    u = numbers(batch, f"x{i}")
                    made.append(pa.array(normal_ppf_values(np.clip(normal_cdf_values(u), EPSILON, 1 - EPSILON) if z else u), from_pandas=True))
                yield pa.RecordBatch.from_arrays(made, names=[f"x{i}" for i in range(len(bent))])

        rows = out.select(*[col(f"{c}__value").alias(f"x{i}") for i, c in enumerate(self.columns)])
        done = rows.mapInArrow(scores, ", ".join(f"x{i} double" for i in range(len(bent))))
        return done.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(self.columns)])

    def sample(self, spark, n: int, seed: int = 0, start: int = 0) -> DataFrame:
        """(id, columns): independent normals per id, mixed by the Cholesky factor in one select."""
        m, factor, seeds = len(self.columns), self.factor, [seed * 101 + j for j in range(len(self.columns))]
        as_uniform = [c in self.roles.categorical for c in self.columns]

        def draw(batches):
            for batch in batches:
                mixed = normal_ppf_values(keyed_uniform_values(batch.column("id").to_numpy(), seeds)) @ factor.T
                cells = [pa.array(normal_cdf_values(mixed[:, i]) if u else mixed[:, i]) for i, u in enumerate(as_uniform)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *cells], names=["id", *[f"x{i}" for i in range(m)]])

        out = spark.range(start, start + n).mapInArrow(draw, "id bigint, " + ", ".join(f"x{i} double" for i in range(m)))
        out = out.select("id", *[F.col(f"x{i}").alias(f"{c}__value") for i, c in enumerate(self.columns)])
        for c, e in self.encoders.items():
            out = e.decode(out, c, c).drop(*e.output_columns(c))
        return out.select("id", *[col(c) for c in self.columns])
