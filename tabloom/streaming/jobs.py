"""Structured Streaming forms of the encoder and of statistic thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalar import col
from tabloom.sources.io import scratch


def encode_stream(stream: DataFrame, encoder) -> DataFrame:
    """Apply a fitted table encoder; stateless, so it is the batch plan on a stream."""
    return encoder.transform(stream)


def decode_stream(stream: DataFrame, encoder) -> DataFrame:
    """Undo a fitted table encoder on a stream; large sets of categories are searched in tables fixed beforehand."""
    return encoder.reverse_transform(stream)


def thin_stream(stream: DataFrame, name: list[str], time: str, value: str, every: str, late: str) -> DataFrame:
    """(name, window start, mean, n) per event-time window; rows later than ``late`` are dropped."""
    timed = stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(*[col(n) for n in name], F.window(col(time), every).alias("w"))
    return grouped.agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n")).select(
        *name, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "value", "n")


def run_to_files(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run all available input once into parquet and read the result."""
    return run_counting(stream, spark, name, mode)[0]


def run_counting(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> tuple[DataFrame, int, int]:
    """The result of all available input, the micro-batches it took, and the state rows that came too late."""
    base = scratch(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
             .option("path", f"{base}/data").trigger(availableNow=True).start())
    query.awaitTermination()
    steps = query.recentProgress
    late = sum(int(s["numRowsDroppedByWatermark"]) for p in steps for s in p["stateOperators"])
    batches = sum(p["numInputRows"] > 0 for p in steps)
    result = spark.read.schema(stream.schema).parquet(f"{base}/data")
    return result, batches, late


def in_arrivals(df: DataFrame, arrival: Column, count: int, path: str) -> str:
    """The rows as files in the order of an arrival number below ``count``, for streams of several micro-batches."""
    for k in range(count):
        df.where(arrival == k).coalesce(1).write.mode("append").parquet(path)
    return path


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder or glob of parquet files as a stream with the batch table's schema."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
