"""Reading and writing tables, metric rows and fitted state."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.order import TOP_LIMIT, top_rows
from tabloom.functions.scalar import col
from tabloom.session import shared_dir

MODEL_SCHEMA = "name string, shape array<int>, data array<double>"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header and a given schema; .gz files are unpacked by name.

    A gzip file cannot be split: one task reads it. Write cohorts as parquet.
    """
    return spark.read.schema(schema).csv(path, header=True, **options)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A prepared flat table; CSV needs its schema, parquet carries one."""
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return read_csv(spark, path, schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def first_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """A bounded scan: the first n rows of a stated order, in that order."""
    by = [col(o) for o in order]
    return df.orderBy(*by).limit(n) if n <= TOP_LIMIT else top_rows(df, by, n).orderBy(*by)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_cohort(df: DataFrame, path: str) -> int:
    """Write parquet and return the row count, counted by the write itself."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    return seen.get["rows"]


def append_metrics(df: DataFrame, path: str, method: str) -> None:
    """Add metric rows under their method's partition."""
    df.withColumn("method", F.lit(method)).write.mode("append").partitionBy("method").parquet(path)


def save_model(spark: SparkSession, params: dict[str, np.ndarray], path: str, state: dict | None = None) -> None:
    """One row per parameter array; plain state (widths, encoder numbers) as a JSON row."""
    rows = [(k, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for k, v in params.items()]
    spark.createDataFrame(rows, MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/arrays")
    text = json.dumps(state or {})
    spark.createDataFrame([(text,)], "state string").write.mode("overwrite").parquet(f"{path}/state")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    rows = spark.read.parquet(f"{path}/arrays").collect()
    params = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}
    return params, json.loads(spark.read.parquet(f"{path}/state").first()["state"])
