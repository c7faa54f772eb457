import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.privacy import accountant as A
from tabloom.privacy import clip as K
from tabloom.privacy import sampling as S


def value(spark, column, **numbers):
    row = spark.createDataFrame([tuple(map(float, numbers.values()))], ", ".join(f"{k} double" for k in numbers))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("sigma,alpha", [(0.5, 2), (0.5, 32), (1.0, 8), (4.0, 63)])
def test_quadrature_equals_expansion(spark, sigma, alpha):
    q, s, a = F.col("q"), F.col("s"), F.col("a")
    exact = value(spark, A.rdp_integer(q, s, a), q=0.01, s=sigma, a=alpha)
    assert value(spark, A.rdp_fractional(q, s, a), q=0.01, s=sigma, a=alpha) == pytest.approx(exact, rel=1e-5, abs=1e-12)


def test_special_cases(spark):
    q, s, a = F.col("q"), F.col("s"), F.col("a")
    assert value(spark, A.rdp_step(q, s, a), q=0, s=1, a=2) == 0
    assert value(spark, A.rdp_step(q, s, a), q=0.5, s=0, a=2) == math.inf
    assert value(spark, A.rdp_step(q, s, a), q=1, s=2, a=3) == 3 / 8
    assert value(spark, A.rdp_step(q, s, a), q=0.1, s=1, a=math.inf) == math.inf


def epsilon(spark, q, sigma, steps):
    m = spark.createDataFrame([("a", q, sigma, steps)], "dataset string, q double, sigma double, steps bigint")
    return A.privacy_spent(A.compose(m, ["dataset"], A.INTEGER_ORDERS, False), ["dataset"], 1e-5).first()


def test_ledger_composition_and_monotonicity(spark):
    ledger = spark.createDataFrame([("a", 1e-5, 1.0, 10), ("a", 1e-4, 3.0, 4)], "dataset string, q double, sigma double, steps bigint")
    both = A.privacy_spent(A.compose(ledger, ["dataset"], A.INTEGER_ORDERS, False), ["dataset"], 1e-5).first()
    assert both["epsilon"] > 0 and both["best_alpha"] in A.INTEGER_ORDERS
    base = epsilon(spark, 0.01, 1.0, 100)["epsilon"]
    assert epsilon(spark, 0.01, 2.0, 100)["epsilon"] < base < epsilon(spark, 0.01, 1.0, 200)["epsilon"]


def test_noise_is_feasible_and_tight(spark):
    wanted = spark.createDataFrame([(3.0, 0.05, 2)], "target double, q double, epochs int")
    sigma = A.noise_for_epsilon(wanted, 1e-5).first()["sigma"]
    steps = 2 * 20
    assert epsilon(spark, 0.05, sigma, steps)["epsilon"] <= 3.0 < epsilon(spark, 0.05, sigma - 0.02, steps)["epsilon"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=3).tolist()) for i in range(64)]
    return rows, spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>").repartition(4)


def local_sum(rows, thresholds, per_block):
    total = np.zeros(9)
    for _, a, b in rows:
        if per_block:
            parts = [np.array(v) * min(1, c / (np.linalg.norm(v) + 1e-6)) for v, c in zip((a, b), thresholds)]
            total += np.concatenate(parts)
        else:
            v = np.array(a + b)
            total += v * min(1, thresholds[0] / (np.linalg.norm(v) + 1e-6))
    return total


@pytest.mark.parametrize("thresholds,per_block", [([0.003], False), ([1e6], False), ([1.5, 0.7], True), ([1.0], True)])
def test_clipped_sum(vectors, thresholds, per_block):
    rows, df = vectors
    got = [r["total"] for r in K.clipped_sum(df, ["a", "b"], thresholds, per_block).orderBy("block", "pos").collect()]
    assert np.allclose(got, local_sum(rows, thresholds * (2 if len(thresholds) == 1 and per_block else 1), per_block), atol=1e-9)


def test_sub_batches_add_up(vectors):
    _, df = vectors
    whole = K.clipped_sum(df, ["a", "b"], [1.0])
    parts = [K.clipped_sum(df.where(F.pmod("id", F.lit(4)) == i), ["a", "b"], [1.0]) for i in range(4)]
    added = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("block", "pos").agg(F.sum("total").alias("t"))
    for r in whole.join(added, ["block", "pos"]).collect():
        assert r["t"] == pytest.approx(r["total"], abs=1e-9)


def test_threshold_mismatch_and_noise(vectors):
    _, df = vectors
    with pytest.raises(ValueError):
        K.clipped_sum(df, ["a", "b"], [1.0, 2.0, 3.0], True)
    with pytest.raises(ValueError):
        K.clipped_sum(df, ["a", "b"], [1.0, 2.0])
    def values(seed):
        return [r["value"] for r in K.noisy_mean(df, ["a", "b"], [1.0], 2.0, seed=seed).orderBy("block", "pos").collect()]
    assert values(1) == values(1) and values(1) != values(2)
    assert K.noise_scale([3.0, 4.0], 2.0) == 10.0


def test_poisson_batches(spark):
    df = spark.range(5000)
    out = S.poisson_batches(df, ["id"], 0.05, seed=1)
    n = out.groupBy("batch").count().toPandas()
    assert len(n) == 20 and (abs(n["count"] - 250) < 4 * math.sqrt(5000 * 0.05 * 0.95)).all()
    again = S.poisson_batches(df.repartition(7), ["id"], 0.05, seed=1)
    assert out.exceptAll(again).isEmpty()
    assert out.groupBy("id", "batch").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        S.sample_rate(rows=10, batch=20)


def test_number_of_batches_is_binomial(spark):
    """A row costs as much as it has batches, so a thousand batches are drawn from as few numbers."""
    cdf = S.binomial_cdf(1000, 0.001)
    assert len(cdf) < 30 and abs(cdf[0] - 0.999**1000) < 1e-12 and cdf == sorted(cdf)
    rows = spark.range(20_000)
    drawn = S.poisson_batches(rows, ["id"], 0.001, seed=4)
    per_row = {r["n"]: r["count"] for r in drawn.groupBy("id").agg(F.count("*").alias("n")).groupBy("n").count().collect()}
    for n in (1, 2, 3):
        p = cdf[n] - cdf[n - 1]
        assert abs(per_row[n] - 20_000 * p) < 5 * math.sqrt(20_000 * p)
    assert drawn.agg(F.min("batch"), F.max("batch")).first() == (1, 1000)
    assert S.poisson_batches(rows, ["id"], 1.0, batches=3).count() == 60_000
