"""Fitted encoders as files: one JSON state, and a table for each large set of categories.

A saved encoder is a folder. ``state`` holds one row with the format's number,
the kind of encoder and its state as JSON; it is written last, so a folder
without it is not a saved encoder. ``tables/<i>`` are the category tables that
the state names. Nothing is pickled, so a folder can be read by other versions
and other languages.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import math
from decimal import Decimal

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tabloom.operators.categorical import Categories
from tabloom.operators.encoder import REGISTRY, ColumnEncoder, NullFill
from tabloom.roles import ColumnRoles

FORMAT = 1
MODULES = ("operators.numeric", "operators.categorical", "operators.mixture", "operators.copula", "operators.fields",
           "operators.table", "plans.flat")  # which register the library's own encoders
KINDS: dict[str, tuple[type, tuple[str, ...]]] = {}


def savable(kind: str, *fields: str):
    """A class whose fitted state is the named attributes."""
    def add(cls):
        KINDS[kind] = (cls, fields)
        return cls
    return add


def kind_of(value) -> str:
    for kind, (cls, _) in KINDS.items():
        if type(value) is cls:
            return kind
    for name, cls in REGISTRY.items():
        if type(value) is cls:
            return f"column:{name}"
    raise TypeError(f"{type(value).__name__} is not registered, so it could not be found again")


class _Writer:
    """Values to JSON; what JSON lacks becomes an object with one key that begins with ``$``."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def plain(self, v, at: str):
        if isinstance(v, np.generic):
            v = v.item()
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else {"$float": str(v)}
        if isinstance(v, list) and not isinstance(v, Row):
            return [self.plain(x, at) for x in v]
        if isinstance(v, tuple):
            return {"$tuple": [self.plain(x, at) for x in v]}
        if isinstance(v, dict):
            if all(isinstance(k, str) and not k.startswith("$") for k in v):
                return {k: self.plain(x, f"{at}.{k}") for k, x in v.items()}
            return {"$items": [[self.plain(k, at), self.plain(x, at)] for k, x in v.items()]}
        if isinstance(v, np.ndarray):
            return {"$array": [str(v.dtype), list(v.shape), [self.plain(x, at) for x in v.ravel().tolist()]]}
        if isinstance(v, dt.datetime):
            return {"$datetime": v.isoformat()}
        if isinstance(v, dt.date):
            return {"$date": v.isoformat()}
        if isinstance(v, Decimal):
            return {"$decimal": str(v)}
        if isinstance(v, NullFill):
            return {"$nulls": self.plain(vars(v), at)}
        if isinstance(v, ColumnRoles):
            return {"$roles": self.plain(dict(vars(v)), at)}
        if isinstance(v, Categories):
            return {"$categories": self.categories(v)}
        if isinstance(v, Column):
            raise TypeError(f"{at} is a column expression, which cannot be saved")
        return {"$object": [kind_of(v), self.state(v)]}

    def categories(self, cats: Categories) -> dict:
        if cats.small:
            rows = [[self.plain(x, "categories") for x in r] for r in cats.rows]
            return {"size": cats.size, "schema": cats.table.schema.jsonValue(), "rows": rows}
        self.tables.append(cats.table)
        return {"size": cats.size, "table": len(self.tables) - 1}

    def state(self, value) -> dict:
        names = vars(value) if isinstance(value, ColumnEncoder) else KINDS[kind_of(value)][1]
        return {n: self.plain(getattr(value, n), f"{type(value).__name__}.{n}") for n in names}


class _Reader:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def value(self, v):
        if isinstance(v, list):
            return [self.value(x) for x in v]
        if not isinstance(v, dict):
            return v
        if len(v) == 1 and next(iter(v)).startswith("$"):
            (tag, x), = v.items()
            return self.tagged(tag, x)
        return {k: self.value(x) for k, x in v.items()}

    def tagged(self, tag: str, x):
        if tag == "$float":
            return float(x)
        if tag == "$tuple":
            return tuple(self.value(i) for i in x)
        if tag == "$items":
            return {self.value(k): self.value(i) for k, i in x}
        if tag == "$array":
            return np.array(self.value(x[2]), dtype=x[0]).reshape(x[1])
        if tag == "$datetime":
            return dt.datetime.fromisoformat(x)
        if tag == "$date":
            return dt.date.fromisoformat(x)
        if tag == "$decimal":
            return Decimal(x)
        if tag == "$nulls":
            return NullFill(**self.value(x))
        if tag == "$roles":
            return ColumnRoles(**self.value(x))
        if tag == "$categories":
            return self.categories(x)
        if tag == "$object":
            return self.object(*x)
        raise ValueError(f"unknown part {tag} of a saved encoder")

    def categories(self, x: dict) -> Categories:
        if "table" in x:
            return Categories(self.spark.read.parquet(f"{self.path}/tables/{x['table']}"), x["size"], None)
        schema = T.StructType.fromJson(x["schema"])
        rows = [Row(*schema.names)(*self.value(r)) for r in x["rows"]]
        return Categories(self.spark.createDataFrame(rows, schema), x["size"], rows)

    def object(self, kind: str, state: dict):
        if kind.startswith("column:"):
            name = kind.partition(":")[2]
            if name not in REGISTRY:
                raise KeyError(f"the encoder {name!r} of this folder is not registered; import its module first")
            cls = REGISTRY[name]
        elif kind in KINDS:
            cls = KINDS[kind][0]
        else:
            raise KeyError(f"unknown kind {kind!r} of a saved encoder")
        made = cls.__new__(cls)
        if not isinstance(made, ColumnEncoder):
            made.__init__(**({"roles": None} if kind == "flat" else {}))
        vars(made).update(self.value(state))
        return made


def save_encoder(spark: SparkSession, encoder, path: str, overwrite: bool = False) -> None:
    """Write a fitted column, table or flat encoder to a new folder, or over what is there.

    A loaded encoder encodes and decodes; settings that only matter before
    fitting are not kept, so a table encoder is built anew to be fitted anew.
    """
    if isinstance(encoder, ColumnEncoder):
        encoder._need_fit()
    writer, mode = _Writer(), "overwrite" if overwrite else "errorifexists"
    kind, state = kind_of(encoder), json.dumps(writer.state(encoder))
    for i, table in enumerate(writer.tables):
        table.write.mode(mode).parquet(f"{path}/tables/{i}")
    row = spark.createDataFrame([(FORMAT, kind, state)], "format int, kind string, state string")
    row.coalesce(1).write.mode(mode).parquet(f"{path}/state")


def load_encoder(spark: SparkSession, path: str):
    """A saved encoder; category tables stay in their folder, which must remain."""
    for module in MODULES:
        importlib.import_module(f"tabloom.{module}")
    try:
        row = spark.read.parquet(f"{path}/state").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} holds no saved encoder") from e
    if row is None or row["format"] > FORMAT:
        raise ValueError(f"{path} has format {row and row['format']}, this library reads up to {FORMAT}")
    return _Reader(spark, path).object(row["kind"], json.loads(row["state"]))
