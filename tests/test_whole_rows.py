"""Small and large paths give the same rows, with nulls, ties, unseen and odd values among them."""

import math

import pytest

from tabloom.fidelity import learned, marginal, pairwise
from tabloom.functions import order
from tabloom.functions.skew import hot_keys, skew_join
from tabloom.operators import categorical, dedup
from tabloom.privacy import accountant, clip


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("make", [categorical.LabelEncoder, categorical.CategoricalEncoder])
def test_decode_keeps_rows_without_a_code_on_both_paths(spark, monkeypatch, make):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "id int, x string")
    coded = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, None), (4, float("nan")), (5, 0.9), (6, 2.0), (7, -1.0)],
                                  "id int, x__value double")
    if make is categorical.LabelEncoder:
        coded = coded.where("id != 4")
    small = rows(make().fit(df, "x").decode(coded, "x", "x").select("id", "x"))
    monkeypatch.setattr(categorical, "LITERAL_LIMIT", -1)
    large = rows(make().fit(df, "x").decode(coded, "x", "x").select("id", "x"))
    assert len(small) == coded.count()
    assert [r for r in large if r[0] != 4] == [r for r in small if r[0] != 4] and len(large) == len(small)
    assert (3, None) in large


def test_trim_takes_exactly_n_with_ties_and_nulls(spark, monkeypatch):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,), (2,), (2,)], "x int")
    small = {n: rows(dedup.trim_to(df, n, ["x"])) for n in range(1, 9)}
    monkeypatch.setattr(order, "TOP_LIMIT", 0)
    assert {n: rows(dedup.trim_to(df, n, ["x"])) for n in range(1, 9)} == small


def test_orders_beyond_the_default_have_an_epsilon(spark):
    ledger = spark.createDataFrame([("a", 0.01, 1.0, 100)], "dataset string, q double, sigma double, steps long")
    near = [float(a) for a in range(2, 64)]
    few = accountant.privacy_spent(accountant.compose(ledger, ["dataset"], near), ["dataset"], 1e-5).first()
    more = accountant.privacy_spent(accountant.compose(ledger, ["dataset"], [*near, 128.0, 256.0]), ["dataset"], 1e-5).first()
    assert more["epsilon"] == few["epsilon"] and math.isfinite(more["epsilon"])


def test_unreachable_targets_stay_as_rows(spark):
    wanted = spark.createDataFrame([(2.0, 0.05, 2), (1e-6, 0.05, 2)], "target double, q double, epochs int")
    got = {r["target"]: (r["sigma"], r["feasible"]) for r in accountant.noise_for_epsilon(wanted, 1e-5).collect()}
    assert got[1e-6] == (None, False) and got[2.0][0] > 0 and got[2.0][1]


def test_unseen_categories_count_in_extended_ks_and_detection(spark):
    real = spark.createDataFrame([("a", float(i)) for i in range(60)], "c string, x double")
    new = spark.createDataFrame([("b" if i % 10 else "a", float(i)) for i in range(60)], "c string, x double")
    got = {r["column"]: r["distance"] for r in marginal.ks_extended(real, new, ["c", "x"]).collect()}
    assert abs(got["c"] - 0.9) < 1e-9 and got["x"] == 0
    assert min(r["auc"] for r in learned.detection(real, new, ["c", "x"]).collect()) > 0.8


def test_kl_of_huge_and_missing_values(spark):
    real = spark.createDataFrame([(float(i), 1.0, None) for i in range(20)], "a double, b double, c double")
    other = spark.createDataFrame([(1e15, 1.0, None)] + [(float(i), 1.0, None) for i in range(19)], real.schema)
    got = pairwise.kl_continuous(real, other, ["a", "b"]).collect()
    assert len(got) == 1 and math.isfinite(got[0]["kl"])


def test_null_series_keep_their_rows(spark):
    df = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 4.0), (None, 1, 6.0), (None, 2, 8.0)], "s string, t int, v double")
    got = order.linear_recurrence(df, ["s"], ["t"], "v", 0.5, 0.0, "out")
    assert rows(got.select("s", "t", "out")) == [("s", 1, 1.0), ("s", 2, 2.5), (None, 1, 3.0), (None, 2, 5.5)]


def test_report_of_two_rows(spark):
    norms = spark.createDataFrame([(0, 1.0), (0, 3.0)], "block int, norm double")
    r = clip.clip_report(norms, {0: 2.0}).first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.0, 1.0, 3.0) and r["share_clipped"] == 0.5


def test_left_join_with_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(90)] + [(2, 1), (3, 1), (None, 1)], "k int, i int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    hot = hot_keys(left, ["k"], 8)
    assert [r["k"] for r in hot] == [1] and hot[0]["_salts"] <= 8
    plain = rows(left.join(right, "k", "left").select("k", "i", "v"))
    assert rows(skew_join(left, right, ["k"], hot, "left").select("k", "i", "v")) == plain
    assert rows(skew_join(left, right, ["k"], hot).select("k", "i", "v")) == [r for r in plain if r[2] is not None]
    assert len(plain) == 93

