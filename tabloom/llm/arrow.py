"""How an operator's Python helper meets the rows: Arrow batches in, the same rows with new columns out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import shared_dir

ROWS = 256  # rows handed to a helper at once, which bounds a task's memory


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, to be taken from a table derived from it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def append(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]], make: Callable) -> DataFrame:
    """``df`` with columns computed by Python; an input column of a new column's name is replaced.

    ``make()`` runs once in each task and returns a function that takes the
    input columns as lists and returns one list or Arrow array per new field.
    No row is added, lost or moved.
    """
    new = [n for n, _ in fields]
    keep = [c for c in df.columns if c not in new]
    hidden = {c: f"__in_{i}" for i, c in enumerate(inputs) if c in new}
    source = df.select(*[df[c] for c in keep], *[df[c].alias(h) for c, h in hidden.items()])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    names = [hidden.get(c, c) for c in inputs]
    rows = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(t) for _, t in fields]
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = work(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])
                made = [m if isinstance(m, pa.Array) and m.type == t else pa.array(m, t) for m, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in keep] + made, names=keep + new)

    return source.mapInArrow(run, schema)


def gather(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]], make: Callable) -> DataFrame:
    """Rows that a task makes from its part of ``df``.

    ``make()`` returns (add, finish): ``add`` takes the input columns as lists,
    ``finish`` nothing; both return lists per field, or None for no rows.
    """
    source = df.select(*inputs)
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    new, rows = [n for n, _ in fields], ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(t) for _, t in fields]
        add, finish = make()

        def out(made):
            for at in range(0, len(made[0]), 10_000):
                part = [m[at:at + 10_000] for m in made]
                yield pa.RecordBatch.from_arrays([pa.array(m, t) for m, t in zip(part, types)], names=new)

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = add(*[batch.column(i).to_pylist() for i in range(len(inputs))])
                if made is not None:
                    yield from out(made)
        made = finish()
        if made is not None:
            yield from out(made)

    return source.mapInArrow(run, schema)


def publish(spark: SparkSession, stem: str, data: bytes) -> str:
    """Store ``data`` in the shared folder and hand it to every executor; returns the name for ``local_path``.

    The name holds the content's hash, so a repeated call is the same file, and
    an executor that joins later fetches it as well.
    """
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:16]}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addFile(path.toString())
    return name


def local_path(name: str) -> str:
    return SparkFiles.get(name)
