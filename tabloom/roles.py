"""Column roles: which columns are categorical, continuous or datetime."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CATEGORICAL, CONTINUOUS, DATETIME = "categorical", "continuous", "datetime"

_ALLOWED = {
    CONTINUOUS: (T.NumericType,),
    DATETIME: (T.TimestampType, T.TimestampNTZType, T.DateType),
    CATEGORICAL: (T.StringType, T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType),
}


@dataclass(frozen=True)
class ColumnRoles:
    """Hand-written role lists; ids get no role and are left out."""

    categorical: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=())

    def columns(self) -> list[str]:
        named = [*self.categorical, *self.continuous, *self.datetime]
        return list(self.order) or named

    def check(self, df: DataFrame) -> "ColumnRoles":
        """Raise with the column name when a role does not fit the schema."""
        types = {f.name: f.dataType for f in df.schema.fields}
        seen: set[str] = set()
        for role in (CATEGORICAL, CONTINUOUS, DATETIME):
            for name in getattr(self, role):
                if name not in types:
                    raise KeyError(f"column {name!r} has role {role} but is not in the table")
                if name in seen:
                    raise ValueError(f"column {name!r} has two roles")
                seen.add(name)
                if not isinstance(types[name], _ALLOWED[role]):
                    raise TypeError(f"column {name!r} of type {types[name].simpleString()} cannot be {role}")
        return self
