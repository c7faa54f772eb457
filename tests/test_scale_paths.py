"""The paths taken only by large or skewed inputs give the same results as the small ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.fidelity.distance import gower_mean
from tabloom.functions import order
from tabloom.functions.skew import hot_keys, skew_join
from tabloom.operators import categorical as C
from tabloom.operators import dedup, joins
from tabloom.runs import trials


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows."""
    k = F.when(F.pmod("id", F.lit(3)) == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1)
    return spark.range(6000).select(k.alias("k"), F.col("id").alias("v"))


def test_skew_join_equals_plain_join(spark, hot):
    side = spark.range(98).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert [r["k"] for r in hot_keys(hot, ["k"])] == [0]
    assert pairs(skew_join(hot, side, ["k"]), "k", "v", "w") == pairs(hot.join(side, "k"), "k", "v", "w")


def test_skewed_fanout_keeps_all_pairs(hot):
    left = hot.where("v < 600")
    right = left.select("k", F.col("v").alias("w"))
    assert skew_join(left, right, ["k"]).count() == left.join(right, "k").count()


@pytest.mark.parametrize("hot_left, hot_right", [(True, False), (False, True), (True, True)])
def test_hot_keys_of_either_side(spark, hot, hot_left, hot_right):
    """Repeated rows and null keys included; a null key matches nothing."""
    even = spark.range(98).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    void = spark.createDataFrame([(None, 5), (0, 5), (0, 5)], "k bigint, v bigint")
    left = (hot.where("v < 600") if hot_left else even).union(void)
    right = (hot.where("v < 600") if hot_right else even).union(void).withColumnRenamed("v", "w")
    joined = skew_join(left, right, ["k"])
    assert pairs(joined, "k", "v", "w") == pairs(left.join(right, "k"), "k", "v", "w")
    assert "_salt" in joined._jdf.queryExecution().toString()


def test_lookup_of_few_wide_rows(spark, hot, monkeypatch):
    wide = spark.range(98).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("w"))
    assert joins.is_small(wide) and joins.is_small(wide.limit(0))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 50_000)
    assert not joins.is_small(wide)
    assert joins.lookup_join(hot, wide, ["k"]).count() == 6000


def test_lookup_beyond_the_broadcast_bound(spark, hot, monkeypatch):
    side = spark.range(98).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    out = joins.lookup_join(hot, side, ["k"])
    assert "_salt" in out._jdf.queryExecution().toString()
    assert out.count() == 6000


def test_head_limits_before_the_shuffle(hot):
    plan = dedup.group_head(hot, ["k"], ["v"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_salted_head_equals_plain_head(hot, monkeypatch):
    want = pairs(dedup.group_head(hot, ["k"], ["v"], 5), "k", "v")
    monkeypatch.setattr(dedup, "HEAD_LIMIT", 1)
    assert pairs(dedup.group_head(hot, ["k"], ["v"], 5), "k", "v") == want


def test_order_statistics_by_narrowing(spark, monkeypatch):
    df = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("x"))
    ordered = sorted(r["x"] for r in df.collect())
    monkeypatch.setattr(order, "COLLECT_BOUND", 100)
    got = order.exact_order_statistics(df, "x", [1, 777, 25_000, 50_000])
    assert got == {k: ordered[k - 1] for k in (1, 777, 25_000, 50_000)}


def test_order_statistics_with_heavy_ties(spark, monkeypatch):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5000).otherwise(F.col("id")).alias("x"))
    ordered = sorted(r["x"] for r in df.collect())
    monkeypatch.setattr(order, "COLLECT_BOUND", 50)
    assert order.exact_order_statistics(df, "x", [4500]) == {4500: ordered[4499]}
    with pytest.raises(ValueError):
        order.exact_order_statistics(df, "x", [9001])


def test_running_totals_over_blocks(spark):
    df = spark.range(2000).select(F.lit("c").alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("x"))
    edges = order.quantile_edges(df, ["x"], 16)["x"]
    counts = order.add_bucket(df, "x", edges, "blk").groupBy("g", "blk", "x").agg(F.count(F.lit(1)).alias("n"))
    assert counts.select("blk").distinct().count() > 10
    got = order.running_totals(counts, ["g"], "blk", [F.col("x")], ["n"], next_of="x")
    w = Window.partitionBy("g").orderBy("x")
    want = counts.select("x", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_n"), F.lead("x").over(w).alias("next_value"))
    key = lambda rows: sorted((r["x"], r["cum_n"], r["next_value"]) for r in rows.where("next_value is not null").collect())
    assert key(got) == key(want)


def test_linear_recurrence_on_a_long_series(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"s": np.where(np.arange(900) % 3 > 0, 0, np.arange(900) % 7), "i": np.arange(900), "x": rng.normal(size=900)})
    got = order.linear_recurrence(spark.createDataFrame(pdf), ["s"], ["i"], "x", 0.9, 2.0, "t").toPandas()
    want = {}
    state = {}
    for s, i, x in pdf.itertuples(index=False):
        state[s] = 0.1 * x + 0.9 * state.get(s, 2.0)
        want[(s, i)] = state[s]
    assert len(got) == 900
    assert max(abs(r.t - want[(r.s, r.i)]) for r in got.itertuples()) < 1e-9


def test_intervals_in_blocks(spark, monkeypatch):
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(500))).cast("string").alias("c"))
    small = C.CategoricalEncoder().fit(df, "c").cats.table
    monkeypatch.setattr(C, "WINDOW_LIMIT", 10)
    large = C.CategoricalEncoder().fit(df, "c").cats.table
    assert pairs(small, "value", "n", "start", "mid") == pairs(large, "value", "n", "start", "mid")


@pytest.mark.parametrize("by", ["nearest", "interval"])
def test_many_categories_by_join(spark, monkeypatch, by):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(400)).cast("string")).alias("c"))
    df = df.withColumn("c", F.nullif("c", F.lit("7")))
    u = spark.range(3000).select("id", ((F.col("id") + 0.5) / 3000).alias("c__value"))

    def run():
        e = C.CategoricalEncoder(lookup_by=by).fit(df, "c")
        encoded = e.transform(df, "c")
        return (pairs(encoded, "id", "c__value"), sorted(map(str, e.reverse_transform(u, "c").collect())),
                sorted(map(str, e.reverse_transform(encoded, "c").collect())), sorted(map(str, df.collect())))

    small = run()
    monkeypatch.setattr(C, "LITERAL_LIMIT", 10)
    monkeypatch.setattr(C, "CELLS", 64)
    large = run()
    assert small == large
    assert large[2] == large[3]


def test_many_labels(spark, monkeypatch):
    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(90)).cast("string").alias("c"))
    small = C.LabelEncoder(order="id").fit(df, "c")
    want = pairs(small.transform(df, "c"), "id", "c__value")
    monkeypatch.setattr(C, "LITERAL_LIMIT", 5)
    monkeypatch.setattr(C, "WINDOW_LIMIT", 5)
    large = C.LabelEncoder(order="id").fit(df, "c")
    coded = large.transform(df, "c")
    assert pairs(coded, "id", "c__value") == want
    assert pairs(large.reverse_transform(coded, "c"), "id", "c") == pairs(df, "id", "c")


def test_pareto_rounds_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 40, size=(600, 3))
    df = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(points)], "t int, a int, b int, c int")
    want = [i for i, p in enumerate(points) if not any((q >= p).all() and (q > p).any() for q in points)]
    monkeypatch.setattr(trials, "CHUNK", 4)
    assert [t for t, in pairs(trials.pareto_front(df, ["a", "b", "c"]), "t")] == want


def test_gower_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"x": rng.integers(0, 20, 80).astype(float), "y": rng.normal(size=80), "c": rng.choice(list("abc"), 80)})
    b = pd.DataFrame({"x": rng.integers(5, 30, 60).astype(float), "y": rng.normal(size=60), "c": rng.choice(list("bcd"), 60)})
    want = 0.0
    for n in ("x", "y"):
        span = max(a[n].max(), b[n].max()) - min(a[n].min(), b[n].min())
        want += np.abs(a[n].to_numpy()[:, None] - b[n].to_numpy()[None, :]).mean() / span
    want += (a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :]).mean()
    got = gower_mean(spark.createDataFrame(a), spark.createDataFrame(b), ["x", "y"], ["c"]).first()["gower"]
    assert got == pytest.approx(want / 3, abs=1e-12)


def test_trim_by_border(hot, monkeypatch):
    want = pairs(dedup.trim_to(hot, 123, ["v"]), "v")
    monkeypatch.setattr(order, "TOP_LIMIT", 10)
    assert pairs(dedup.trim_to(hot, 123, ["v"]), "v") == want
    assert dedup.trim_to(hot, 10**6, ["v"]).count() == 6000


def test_order_statistics_of_wide_integers(spark, monkeypatch):
    df = spark.range(3000).select(F.xxhash64("id").alias("x"))
    ordered = sorted(r["x"] for r in df.collect())
    monkeypatch.setattr(order, "COLLECT_BOUND", 50)
    assert order.exact_order_statistics(df, "x", [1, 1500, 3000]) == {k: ordered[k - 1] for k in (1, 1500, 3000)}
