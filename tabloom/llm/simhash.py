"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits have a point between them
that is at most one bit from one and two bits from the other. The ball of two
bits has 2,081 members, so it is kept for the last resort. First the 64 bits
are cut into thirds and each third is left out in turn: of three differing bits
at least one is then hidden, two or fewer remain, and the balls of half that
radius (one bit: 131 variants in all) must meet. The fingerprints that share a variant
are compared among themselves while they are few (``CROWD``), which among many
fingerprints they are by chance alone. In a larger crowd those around one point
are linked to the least of them. Most of a crowd is then one component, and
only what is outside of it is compared with the whole crowd: rows in proportion
to the crowd, not to its pairs. Where that is more than ``OTHERS``, those
outside go on to the full balls and the rest of the crowd to the balls of one
bit: fingerprints within one bit of a point and those within two bits of it are
at most three apart, so one link from each to the least of the former replaces
all their pairs, whatever their number.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.llm.arrow import append, own
from tabloom.llm.components import components
from tabloom.session import checkpoint

WORDS, SEED, RADIUS = 3, 42, 3
TASKS = 48  # that make the variants, at least
CROWD = 16  # fingerprints of a variant up to which they are compared with each other
OTHERS = 64  # fingerprints outside a crowd's largest component up to which they are compared with all of it; more are linked by balls
THIRDS = ((0, 21), (21, 42), (42, 64))


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint; a text without words has fingerprint zero."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        parts = [joined[a:b - 1] for a, b in zip(starts, starts[WORDS:])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long of the same bits."""
    def make():
        return lambda texts: [pa.array(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))]

    return append(df, [text], [(fingerprint, T.LongType())], make)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def thirds_variants(df: DataFrame) -> DataFrame:
    """Every variant within one bit, once for each third left out; the third's number takes its place."""
    made = []
    for number, (a, b) in enumerate(THIRDS):
        hidden = (1 << b) - (1 << a)
        rest = F.col("fp").bitwiseAND(F.lit(signed(~hidden & (1 << 64) - 1)))
        mark = (number + 1) << a
        made += [rest.bitwiseXOR(F.lit(signed(mark | flip)))
                 for flip in [0, *(1 << i for i in range(64) if not a <= i < b)]]
    return df.select("fp", F.explode(F.array(*made)).alias("variant"))


def near_ball(df: DataFrame) -> DataFrame:
    """Every variant within one bit, with the number of bits flipped."""
    one = F.array(*[F.lit(signed(m)) for m in [0, *(1 << i for i in range(64))]])
    return df.select("fp", F.posexplode(one).alias("i", "x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("variant"), F.when(F.col("x") != 0, 1).otherwise(0).alias("flips"))


def ball(df: DataFrame) -> DataFrame:
    """Every variant within two bits, with the number of bits flipped."""
    one = F.array(*[F.lit(signed(m)) for m in [0, *(1 << i for i in range(64))]])
    # the second flip is above the first, so that no variant comes twice; a first flip of nothing stands for itself
    first = df.select("fp", F.posexplode(one).alias("i", "x"))
    rest = F.expr("concat(array(0L), transform(sequence(i, 64), j -> if(i > 0 and j > i and j <= 64, "
                  "shiftleft(1L, j - 1), 0L)))")
    second = first.select("fp", "i", "x", F.explode(F.array_distinct(rest)).alias("y"))
    return second.select("fp", F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y")).alias("variant"),
                         (F.when(F.col("x") != 0, 1).otherwise(0) + F.when(F.col("y") != 0, 1).otherwise(0)).alias("flips"))


def crowd_links(met: DataFrame) -> DataFrame:
    """(u, v) of all that differ in few enough bits among the 3 to ``CROWD`` fingerprints of a variant; no other pair leaves a row."""
    crowds = met.filter((F.col("n") > 2) & (F.col("n") <= CROWD)).groupBy("variant").agg(F.collect_list("u").alias("us"))
    each = crowds.select("us", F.explode("us").alias("u"))
    close = F.filter("us", lambda v: (v < F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= RADIUS))
    return each.select("u", F.explode(close).alias("v"))


def point() -> Column:
    """The whole point, one bit from u at most, that u and its variant tell: the hidden third is as in u."""
    found = []
    for number, (a, b) in enumerate(THIRDS):
        hidden = (1 << b) - (1 << a)
        rest = F.col("variant").bitwiseAND(F.lit(signed(~hidden & (1 << 64) - 1)))
        whole = rest.bitwiseOR(F.col("u").bitwiseAND(F.lit(signed(hidden))))
        marked = F.col("variant").bitwiseAND(F.lit(signed(hidden))) == F.lit(signed((number + 1) << a))
        found.append(F.when(marked & (F.bit_count(whole.bitwiseXOR(F.col("u"))) <= 1), whole))
    return F.coalesce(*found)


def stars(members: DataFrame) -> DataFrame:
    """Links of all pairs (u: fp) within three bits of which one is a ``minor``; others are at most three apart as well."""
    balls = ball(members.filter("minor").select("fp")).union(near_ball(members.filter("not minor").select("fp")))
    at = Window.partitionBy("variant")  # 2,081 fingerprints at most lie within two bits of a point
    least = balls.withColumn("v", F.min(F.when(F.col("flips") <= 1, F.col("fp"))).over(at))
    return least.filter("v is not null and v != fp").select(F.col("fp").alias("u"), "v").distinct()


def links_across(crowds: DataFrame) -> DataFrame:
    """Links (u, v) between the components (root) of the fingerprints u of each crowd (variant).

    Of two components of a crowd one is not its largest, so every pair that is
    still to be found has a fingerprint outside the largest component.
    """
    parts = crowds.groupBy("variant", "root").agg(F.count("*").alias("n"))
    largest = parts.groupBy("variant").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"))
    largest = largest.select("variant", F.col("largest.root").alias("main"), (F.col("all") - F.col("largest.n")).alias("outside"))
    parted = checkpoint(crowds.join(largest.filter("outside > 0"), "variant"))
    few = parted.filter(F.col("outside") <= OTHERS)
    others = few.filter("root != main").groupBy("variant").agg(F.collect_list(F.struct("u", "root")).alias("others"))
    close = F.filter("others", lambda o: (o["root"] != F.col("root")) & (F.bit_count(o["u"].bitwiseXOR(F.col("u"))) <= RADIUS))
    met = few.select("variant", "u", "root").join(others, "variant").withColumn(
        "roots", F.array_distinct(F.transform(close, lambda o: o["root"])))
    direct = met.select(F.col("root").alias("u"), F.explode("roots").alias("v")).distinct()
    many = parted.filter(F.col("outside") > OTHERS).groupBy(F.col("u").alias("fp")).agg(
        F.max(F.col("root") != F.col("main")).alias("minor"))
    return direct.union(stars(many))


def links(prints: DataFrame) -> DataFrame:
    """(u, v) links that join exactly the fingerprints (column fp, distinct) reachable by steps of three bits or fewer."""
    same = Window.partitionBy("variant")  # of the fingerprints within one bit of a point, one third left out
    met = thirds_variants(prints).withColumns({"n": F.count("*").over(same), "v": F.min("fp").over(same)})
    met = checkpoint(met.filter("n > 1").select(F.col("fp").alias("u"), "v", "n", "variant"))
    pairs = met.filter("n = 2 and u != v").select("u", "v").union(crowd_links(met)).distinct().filter(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    crowds = met.filter(F.col("n") > CROWD).select("u", "variant")
    if crowds.isEmpty():
        return pairs
    around = Window.partitionBy("point")  # 65 fingerprints at most
    near = crowds.select("u", point().alias("point")).distinct().withColumn("v", F.min("u").over(around)).filter("u != v")
    found = checkpoint(components(pairs.union(near.select("u", "v"))))
    roots = crowds.join(found.withColumnRenamed("node", "u"), "u", "left")
    roots = checkpoint(roots.withColumn("root", F.coalesce("root", "u")))
    return found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links_across(roots))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root) of every row of ``df``.

    Texts without words all have fingerprint zero and are linked like others.
    Repeated rows appear as often as in the input. A null id counts as larger
    than any other: a component has a null id only if all its rows do. ``root``
    names the component by its least fingerprint. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")),
                                     "__text", "fp").select("doc_id", "fp"))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    spread = distinct.select("fp").repartition(max(TASKS, distinct.rdd.getNumPartitions()), "fp")  # few rows now, 131 times as many next
    found = components(links(spread)).withColumnRenamed("node", "fp")
    named = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = checkpoint(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one of each component of near-duplicates: that with the smallest id, once if it is repeated.

    An id that occurs once tells its row. Only rows whose id is repeated are
    told by their fingerprints, which are then made anew for these rows alone.
    """
    found = checkpoint(near_duplicates(df, doc_id, text))
    ids = checkpoint(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("component_id")))
    alone = ids.filter("n = 1").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    again = ids.filter("n > 1").select(F.col("doc_id").alias("__id"))
    once = df.join(alone, df[doc_id].eqNullSafe(alone["__id"]), "left_semi")
    if again.isEmpty():
        return once.select(*own(df))
    firsts = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).join(
        again, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    firsts = firsts.groupBy("root").agg(F.first("doc_id").alias("__id"), F.min("fp").alias("__fp"))
    rows = fingerprints(df.join(again, df[doc_id].eqNullSafe(again["__id"]), "left_semi"), text, "__own")
    more = rows.join(firsts, rows[doc_id].eqNullSafe(firsts["__id"]) & (rows["__own"] == firsts["__fp"]))
    return once.select(*own(df)).union(more.dropDuplicates(["root"]).select(*own(df)))
