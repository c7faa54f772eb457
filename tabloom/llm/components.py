"""Connected components of a link table by alternating stars, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.arrow import gather
from tabloom.session import checkpoint

HELD = 300_000  # nodes that a task's forest holds before it is sent on
EDGE = [("u", T.LongType()), ("v", T.LongType())]


def local_forests(links: DataFrame) -> DataFrame:
    """The links (u > v) of each partition as stars: at most one a node, same components."""
    def make():
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def flush():
            stars = [(x, find(x)) for x in list(root)]
            root.clear()
            stars = [s for s in stars if s[0] != s[1]]
            return [[a for a, _ in stars], [b for _, b in stars]] if stars else None

        def add(us, vs):
            for u, v in zip(us, vs):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            return flush() if len(root) > HELD else None

        return add, flush

    return gather(links, ["u", "v"], EDGE, make)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long, null links are void); root is the component's least node.

    Each round points every node's neighbours at the least one around it, first
    outwards, then inwards, and ends when no link moves. A node of many links
    is only ever the key of a minimum and of a join whose large side Spark splits.
    """
    links = links.filter("u is not null and v is not null and u != v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = checkpoint(local_forests(links).distinct())
    before = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        outward = both.join(least, both.u == least.k).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        outward = local_forests(outward.filter("u != v")).distinct()
        least = outward.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        met = outward.join(least, outward.u == least.k)
        inward = met.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(
            least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        links = checkpoint(local_forests(inward).distinct())
