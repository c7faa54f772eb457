"""Joins and caps that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import col


def hot_keys(df: DataFrame, keys: list[str], parts: int | None = None) -> list[Row]:
    """Keys with more than a fair task's share of rows, and the salts each needs.

    Fewer than ``parts`` keys can exceed 1/``parts`` of the rows, so the result
    is bounded however large the table is. One pass tells whether there is any.
    """
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    seen = counted.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    share = -(-(seen["rows"] or 0) // parts)
    if (seen["most"] or 0) <= share:
        return []
    return (counted.where(F.col("_n") > F.lit(share))
            .withColumn("_salts", F.ceil(F.col("_n") / F.lit(share)).cast("int"))  # at most ``parts``
            .drop("_n").collect())


def skew_join(left: DataFrame, right: DataFrame, on: list[str], hot: list[Row] | None = None, how: str = "inner",
              hot_right: list[Row] | None = None) -> DataFrame:
    """Inner or left equi-join whose hot keys are spread over salts.

    A hot key's rows on one side are spread, those on the other copied once per
    salt. A key that is hot on both sides becomes a grid of cells; the copies
    are then far fewer than the pairs that the join returns. A left join spreads
    the left side only, since a copied left row could miss its match. With no
    hot key, and on a stream, whose keys cannot be counted, this is the plain join.
    """
    still = not (left.isStreaming or right.isStreaming)
    if hot is None:
        hot = hot_keys(left, on) if still else []
    if how != "inner":
        hot_right = []
    elif hot_right is None:
        hot_right = hot_keys(right, on) if still else []
    if not hot and not hot_right:
        return left.join(right, on, how)
    grid: dict[tuple, list[int]] = {}
    for side, rows in enumerate((hot, hot_right)):
        for r in rows:
            grid.setdefault(tuple(r[k] for k in on), [1, 1])[side] = r["_salts"]
    schema = T.StructType([*left.select(*[col(k) for k in on]).schema.fields,
                           T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType())])
    table = F.broadcast(left.sparkSession.createDataFrame([(*k, *salts) for k, salts in grid.items()], schema))

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one of its own salts and in all of the other side's."""
        marked = df.join(table, on, "left")
        salted = marked.withColumn(f"_salt{own}", F.when(F.col(own).isNotNull(), F.pmod(
            F.xxhash64(*[col(c) for c in df.columns]), F.col(own))).otherwise(F.lit(0)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return salted.withColumn(f"_salt{other}", every).drop("_a", "_b")

    cells = ["_salt_a", "_salt_b"]
    return spread(left, "_a", "_b").join(spread(right, "_b", "_a"), [*on, *cells], how).drop(*cells)
