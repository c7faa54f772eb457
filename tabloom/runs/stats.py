"""Named statistic series: select, remove and thin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.order import add_bucket, quantile_edges, running_totals
from tabloom.functions.scalar import col


def with_steps(df: DataFrame, name: list[str], order: str, out: str = "step") -> DataFrame:
    """Number the values of each series from 0 along a unique numeric ``order``.

    Ranks are taken inside blocks of ``order`` plus block offsets, so a long
    series is not sorted in one task.
    """
    edges = quantile_edges(df, [order])[order]
    blocks = add_bucket(df.withColumn("_o", col(order).cast("double")), "_o", edges, "blk").withColumn("_one", F.lit(1))
    ranked = running_totals(blocks, name, "blk", [col(order)], ["_one"])
    return ranked.select(*[col(c) for c in df.columns], (F.col("cum__one") - 1).alias(out))


def _windows(df: DataFrame, step: str, value: str, k: int) -> DataFrame:
    """Each value in its window, plus a mark on the window that a value closes."""
    w = F.floor(col(step) / k)
    inside = F.struct(w.alias("window"), col(value).alias("v"), F.lit(False).alias("closed"))
    closes = F.struct((w - 1).alias("window"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("closed"))
    both = F.when((F.pmod(col(step), F.lit(k)) == 0) & (col(step) > 0), F.array(inside, closes)).otherwise(F.array(inside))
    return df.withColumn("_x", F.explode(both))


def thin(df: DataFrame, name: list[str], step: str, value: str, k: int, reduction: str = "avg") -> DataFrame:
    """(name, window, value): one point per k values, emitted once the next window starts.

    "avg" takes the mean of the k values, "sample" the last of them.
    """
    rows = _windows(df, step, value, k)
    keys = [*[col(n) for n in name], F.col("_x.window").alias("window")]
    point = F.avg("_x.v") if reduction == "avg" else F.max_by("_x.v", F.when(~F.col("_x.closed"), col(step)))
    out = rows.groupBy(*keys).agg(point.alias("value"), F.bool_or("_x.closed").alias("closed"))
    return out.where("closed").drop("closed")


def select(df: DataFrame, kind: str | None = None, name: str | None = None, kind_column: str = "type",
           name_column: str = "name") -> DataFrame:
    """Statistics of a type and/or name."""
    for column, wanted in ((kind_column, kind), (name_column, name)):
        if wanted is not None:
            df = df.where(col(column) == wanted)
    return df


def remove(df: DataFrame, kind: str | None = None, name: str | None = None, kind_column: str = "type",
           name_column: str = "name") -> DataFrame:
    """All statistics but those of a type and name."""
    hit = F.lit(True)
    for column, wanted in ((kind_column, kind), (name_column, name)):
        if wanted is not None:
            hit = hit & (col(column) == wanted)
    return df.where(~hit)
