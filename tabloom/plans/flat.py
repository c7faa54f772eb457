"""Flat-table encoding by roles: one-hots first, scaled continuous columns last.

Covers the survival table (renames and integer casts, no datetimes) and the
clinical table (datetimes become numbers first; that numeric copy is also the
view the fidelity metrics use).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import col
from tabloom.operators import shape
from tabloom.operators.categorical import OneHotEncoder, dense_to_sparse, sparse_to_dense
from tabloom.operators.encoder import NotFittedError, fit_all
from tabloom.operators.mixture import MixtureEncoder
from tabloom.operators.numeric import DatetimeEncoder, StandardEncoder
from tabloom.operators.store import savable
from tabloom.operators.table import TableEncoder
from tabloom.roles import ColumnRoles


@savable("flat", "roles", "method", "rename", "integers", "keep", "mixture_options", "dates", "table")
class FlatEncoder:
    """Fit once, then encode, decode and view tables lazily.

    ``method`` is "standard" (suits near-Gaussian columns) or "mixture"
    (multi-modal columns). ``rename`` and ``integers`` are applied first;
    ``keep`` columns (row keys) pass through. A category column with very many
    values is one sparse column here, and as wide as its values in a vector.
    """

    def __init__(self, roles: ColumnRoles, method: str = "standard", rename: dict[str, str] | None = None,
                 integers: tuple[str, ...] = (), keep: tuple[str, ...] = (), mixture_options: dict | None = None):
        if method not in ("standard", "mixture"):
            raise ValueError("method must be 'standard' or 'mixture'")
        self.roles, self.method, self.rename = roles, method, rename or {}
        self.integers, self.keep, self.mixture_options = integers, tuple(keep), mixture_options or {}
        self.dates: dict[str, DatetimeEncoder] = {}
        self.table: TableEncoder | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        out = shape.rename(df, self.rename)
        self.roles.check(out)
        if self.integers:
            out = shape.cast_columns(out, list(self.integers), "int")
        return shape.project(out, [*self.keep, *self.roles.columns()])

    def fit(self, df: DataFrame) -> "FlatEncoder":
        prepared = self.prepare(df)
        self.dates = fit_all(prepared, {c: DatetimeEncoder() for c in self.roles.datetime})
        view = self._numbers(prepared)
        encoders = {c: OneHotEncoder() for c in self.roles.categorical}
        for c in self.continuous:
            encoders[c] = StandardEncoder() if self.method == "standard" else MixtureEncoder(
                keys=list(self.keep) or None, **self.mixture_options)
        self.table = TableEncoder(encoders, keep=self.keep).fit(view)
        return self

    @property
    def continuous(self) -> list[str]:
        return [*self.roles.continuous, *self.roles.datetime]

    def _numbers(self, prepared: DataFrame) -> DataFrame:
        out = prepared
        for c, e in self.dates.items():
            out = e.encode(out, c, c).withColumn(c, col(f"{c}__value")).drop(*e.output_columns(c))
        return out

    def metric_view(self, df: DataFrame) -> DataFrame:
        """The prepared table with datetimes as numbers."""
        return self._numbers(self.prepare(df))

    def _fitted(self) -> TableEncoder:
        if self.table is None:
            raise NotFittedError("fit the flat encoder first")
        return self.table

    @property
    def blocks(self) -> list[list[str]]:
        """One-hot blocks in order: the categorical columns, then mixture components."""
        tree = self._fitted().tree
        fields = [*self.roles.categorical, *[f"{c}__component" for c in self.continuous]]
        return [tree[f]["outputs"] for f in fields if f in tree]

    @property
    def continuous_outputs(self) -> list[str]:
        suffix = "value" if self.method == "standard" else "normalized"
        return [f"{c}__{suffix}" for c in self.continuous]

    @property
    def wide(self) -> dict[str, int]:
        """Sparse columns with the number of their categories."""
        return {p + "__value": e.width for _, e, p in self._fitted().steps if isinstance(e, OneHotEncoder) and e.wide}

    @property
    def widths(self) -> list[int]:
        wide = self.wide
        return [sum(wide.get(c, 1) for c in b) for b in self.blocks]

    @property
    def columns(self) -> list[str]:
        """Encoded columns in model order."""
        return [*[c for b in self.blocks for c in b], *self.continuous_outputs]

    def encode(self, df: DataFrame) -> DataFrame:
        encoded = self._fitted().transform(self.metric_view(df))
        onehots = [c for b in self.blocks for c in b]
        return shape.block_order(encoded, onehots, self.continuous_outputs, list(self.keep))

    def encode_vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        encoded, wide = self.encode(df), self.wide
        if not wide:
            return shape.as_vector(encoded, self.columns, out, list(self.keep))
        parts = [sparse_to_dense(col(c), wide[c]).cast("array<float>") if c in wide else F.array(col(c).cast("float"))
                 for c in self.columns]
        return encoded.select(*[col(k) for k in self.keep], F.concat(*parts).alias(out))

    def from_vector(self, df: DataFrame, vector: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
        """Split an array in model order back into encoded columns."""
        wide, at, parts = self.wide, 0, []
        for c in self.columns:
            if c in wide:
                parts.append(dense_to_sparse(F.slice(col(vector), at + 1, wide[c])).alias(c))
            else:
                parts.append(F.get(col(vector), at).cast("double").alias(c))
            at += wide.get(c, 1)
        return df.select(*[col(k) for k in keep], *parts)

    def decode(self, df: DataFrame) -> DataFrame:
        """Categorical, continuous and datetime columns back, in their original order."""
        out = self._fitted().reverse_transform(df)
        for c, e in self.dates.items():
            if c in out.columns:
                named = out.withColumn(f"{c}__value", col(c).cast("double"))
                out = e.decode(named, c, c).drop(f"{c}__value")
        keep = [k for k in df.columns if k not in self.columns]
        out = shape.project(out, [*keep, *self.roles.columns()])
        return shape.rename(out, {v: k for k, v in self.rename.items()})
