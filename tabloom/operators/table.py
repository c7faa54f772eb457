"""Whole-table encoding: infer types, fit level by level, transform, reverse."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom.functions.scalar import col, nan_to_null
from tabloom.operators.categorical import CategoricalEncoder
from tabloom.operators.encoder import ColumnEncoder, NotFittedError, columns_of, field_prefix, fit_all, free_prefix
from tabloom.operators.mixture import MixtureEncoder, fit_mixture_encoders
from tabloom.operators.numeric import BooleanEncoder, DatetimeEncoder, NumericEncoder
from tabloom.operators.store import savable

NUMERIC_OUTPUTS = ("float", "integer", "numerical", "sparse")

# The default encoder of each data type.
DEFAULTS = {
    "integer": lambda: NumericEncoder(),
    "float": lambda: NumericEncoder(),
    "numerical": lambda: NumericEncoder(),
    "categorical": lambda: CategoricalEncoder(),
    "boolean": lambda: BooleanEncoder(),
    "datetime": lambda: DatetimeEncoder(),
}


def data_type(t: T.DataType, name: str = "") -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.StringType):
        return "categorical"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    raise TypeError(f"column {name!r} has type {t.simpleString()}, which no encoder handles")


def infer_types(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    overrides = overrides or {}
    return {f.name: overrides.get(f.name) or data_type(f.dataType, f.name) for f in df.schema.fields}


@savable("table", "input_columns", "keep", "types", "steps", "tree")
class TableEncoder:
    """Encoders for the columns of a table.

    ``encoders`` overrides by column, ``type_encoders`` by data type and
    ``data_types`` declares types. A tuple of columns is a field with one
    encoder; its columns may be outputs of other encoders, and it is fitted at
    the level at which all of them exist. ``keep`` passes columns (such as row
    keys) through untouched. Fitting runs one shared pass per level: first the
    input columns, then outputs that are not numeric yet, until all are.
    """

    def __init__(self, encoders: dict[str | tuple[str, ...], ColumnEncoder] | None = None, type_encoders: dict | None = None,
                 data_types: dict[str, str] | None = None, keep: tuple[str, ...] = ()):
        self.encoders = dict(encoders or {})
        self.type_encoders = dict(type_encoders or {})
        self.data_types = dict(data_types or {})
        self.keep = tuple(keep)
        self.input_columns: list[str] = []
        self.types: dict[str, str] = {}
        self.tree: dict[str, dict] = {}
        self.steps: list[tuple[str | tuple[str, ...], ColumnEncoder, str]] | None = None

    # settings; any change un-fits ------------------------------------------
    def update_data_types(self, types: dict[str, str]) -> None:
        self.data_types.update(types)
        self.steps = None

    def update_type_encoders(self, encoders: dict) -> None:
        self.type_encoders.update(encoders)
        self.steps = None

    def set_encoders(self, encoders: dict[str, ColumnEncoder]) -> None:
        self.encoders.update(encoders)
        self.steps = None

    def default_for(self, kind: str) -> ColumnEncoder:
        source = self.type_encoders.get(kind, DEFAULTS.get(kind))
        if source is None:
            raise KeyError(f"no encoder for data type {kind!r}")
        return source() if callable(source) else source

    # fitting ---------------------------------------------------------------
    def fit(self, df: DataFrame) -> "TableEncoder":
        df = nan_to_null(df)
        self.input_columns = [c for c in df.columns if c not in self.keep]
        self.types = infer_types(df.select(*[col(c) for c in self.input_columns]), self.data_types)
        field_of = {c: f for f in self.encoders for c in columns_of(f)}
        self.steps, self.tree = [], {}
        current, waiting = df, dict(self.types)  # columns that exist and need an encoder, with their types
        chosen: dict[str, ColumnEncoder] = {}  # encoders that an encoder wants for its outputs
        while waiting:
            level: dict = {}
            for c in waiting:
                field = field_of.get(c, c)
                if set(columns_of(field)) <= set(waiting):
                    level.setdefault(field, self.encoders.get(field) or chosen.get(c) or self.default_for(waiting[c]))
            if not level:  # fields whose other columns never came: their columns are encoded one by one
                for f in {field_of[c] for c in waiting}:
                    field_of = {c: g for c, g in field_of.items() if g != f}
                waiting = {c: t for c, t in waiting.items() if c in self.types or t not in NUMERIC_OUTPUTS}
                continue
            self._fit_level(current, level)
            used = [c for f in level for c in columns_of(f)]
            waiting = {c: t for c, t in waiting.items() if c not in used}
            for field, enc in level.items():
                prefix = free_prefix(current, field, enc)
                self.steps.append((field, enc, prefix))
                outputs = dict(zip(enc.output_columns(prefix), enc.get_output_types().values()))
                self.tree[field_prefix(field)] = {"encoder": type(enc).__name__, "outputs": list(outputs)}
                current = enc.encode(current, field, prefix)
                chosen |= {f"{prefix}__{o}": e for o, e in enc.next_encoders().items()}
                waiting |= {o: kind for o, kind in outputs.items() if o in field_of or kind not in NUMERIC_OUTPUTS}
        done = {f for f, _, _ in self.steps}
        unknown = sorted(map(field_prefix, set(self.encoders) - done))
        if unknown:
            warnings.warn(f"encoders for columns not in the table are ignored: {unknown}")
        return self

    @staticmethod
    def _fit_level(df: DataFrame, level: dict) -> None:
        mixtures = {c: e for c, e in level.items() if isinstance(e, MixtureEncoder) and e.parameters is None}
        if mixtures:
            fit_mixture_encoders(df, mixtures)
        plain = {c: e for c, e in level.items() if c not in mixtures}
        if plain:
            fit_all(df, plain)

    def _need_fit(self) -> None:
        if self.steps is None:
            raise NotFittedError("fit the table encoder first")

    @property
    def final_outputs(self) -> list[str]:
        """Encoded columns in the order of the input columns."""
        self._need_fit()
        out: list[str] = []
        first = {columns_of(f)[0]: field_prefix(f) for f, _, _ in self.steps}
        later = {c for f, _, _ in self.steps for c in columns_of(f)[1:]}

        def begin(c: str) -> None:
            if c not in later:  # a field's outputs stand at its first column
                walk_from(first.get(c, c))

        def walk_from(name: str) -> None:
            if name in self.tree:
                for o in self.tree[name]["outputs"]:
                    begin(o)
            else:
                out.append(name)

        for c in self.input_columns:
            begin(c)
        return out

    # use -------------------------------------------------------------------
    def transform(self, df: DataFrame) -> DataFrame:
        """Columns not known to the encoder first, then the encoded ones."""
        self._need_fit()
        out = nan_to_null(df)
        for name, enc, prefix in self.steps:
            if set(columns_of(name)) <= set(out.columns):
                out = enc.encode(out, name, prefix)
        others = [c for c in df.columns if c not in self.input_columns]
        return out.select(*[col(c) for c in others], *[col(c) for c in self.final_outputs if c in out.columns])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def reverse_transform(self, df: DataFrame) -> DataFrame:
        """Undo the steps from last to first; input columns in their order."""
        self._need_fit()
        out = df
        for name, enc, prefix in reversed(self.steps):
            if set(enc.output_columns(prefix)) <= set(out.columns):
                out = enc.decode(out, prefix, name)
        produced = {o for t in self.tree.values() for o in t["outputs"]}
        others = [c for c in df.columns if c not in produced and c not in self.input_columns]
        return out.select(*[col(c) for c in others], *[col(c) for c in self.input_columns if c in out.columns])

    # lineage ---------------------------------------------------------------
    def lineage(self, spark) -> DataFrame:
        """(field, encoder, output) for every step."""
        self._need_fit()
        rows = [(n, t["encoder"], o) for n, t in self.tree.items() for o in t["outputs"]]
        return spark.createDataFrame(rows, "field string, encoder string, output string")

    def lineage_yaml(self) -> str:
        """The encoder tree as text, one field per block."""
        self._need_fit()
        lines = []
        for name, t in self.tree.items():
            lines.append(f"{json.dumps(name)}:\n  encoder: {t['encoder']}\n  outputs:")
            for o in t["outputs"]:
                nxt = self.tree.get(o)
                lines.append(f"    {json.dumps(o)}: {nxt['encoder'] if nxt else 'null'}")
        return "\n".join(lines) + "\n"


def dotted_names(df: DataFrame) -> DataFrame:
    """``column__output`` to ``column.output`` (needs back-quotes afterwards)."""
    return df.withColumnsRenamed({c: c.replace("__", ".") for c in df.columns})
