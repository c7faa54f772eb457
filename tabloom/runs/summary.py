"""Metric summaries over runs, training logs and early stopping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import col
from tabloom.session import together


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """(ids, name, value), one row per column."""
    numbers = df.select(*[col(i) for i in ids], *[col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot([col(i) for i in ids], [col(c) for c in columns], name, value)


def metric_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, runs) with the population standard deviation."""
    rows = long_form(runs, [], metrics)
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.count("value").alias("runs"))


def multi_run(seeds: list[int], job: Callable[[int], DataFrame]) -> DataFrame:
    """One result row per seed, each from its own Spark job."""
    parts = together([lambda s=s: job(s).withColumn("seed", F.lit(s)) for s in seeds])
    return reduce(lambda a, b: a.unionByName(b), parts)


def early_stop(log: DataFrame, run: list[str], epoch: str, loss: str, patience: int, delta: float) -> DataFrame:
    """(run, epochs, stopped): epochs made when the loss stops improving.

    An epoch improves when its loss is below the best by more than ``delta``;
    the first epoch sets the best and counts as not improved. Training stops
    at the ``patience``-th miss in a row. A run's log is as long as its epochs.
    """
    points = F.sort_array(F.collect_list(F.struct(col(epoch).alias("e"), col(loss).alias("x"))))
    logs = log.groupBy(*[col(r) for r in run]).agg(points.alias("p"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("misses"), F.lit(0).alias("made"),
                     F.lit(False).alias("stopped"))

    def step(s: Column, p: Column) -> Column:
        better = F.coalesce(p["x"] < s["best"] - delta, F.lit(False))
        misses = F.when(better, F.lit(0)).otherwise(s["misses"] + 1)
        moved = F.struct(F.when(better | s["best"].isNull(), p["x"]).otherwise(s["best"]).alias("best"),
                         misses.alias("misses"), (s["made"] + 1).alias("made"), (misses == patience).alias("stopped"))
        return F.when(s["stopped"], s).otherwise(moved)

    done = logs.withColumn("s", F.aggregate("p", start, step))
    return done.select(*run, F.col("s.made").alias("epochs"), F.col("s.stopped").alias("stopped"))
