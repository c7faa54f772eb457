import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions.scalar import with_normal_cdf, with_normal_ppf
from tabloom.operators import numeric as N
from tabloom.operators.categorical import CategoricalEncoder, LabelEncoder, OneHotEncoder
from tabloom.operators.copula import CopulaEncoder, candidates
from tabloom.operators.encoder import NotFittedError, field_prefix, make
from tabloom.operators.mixture import binned_points, fit_mixtures, fit_points
from tabloom.operators.table import TableEncoder, dotted_names, infer_types
from tabloom.roles import ColumnRoles

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def learnt_digits(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return N.RoundedEncoder().fit(df, "x").digits


def numpy_digits(values):
    x = np.array(values, float)
    if ((x % 1) != 0).any():
        return next((d for d in range(15) if (x == x.round(d)).all()), None)
    start = int(np.log10(np.abs(x).max())) if np.abs(x).max() else 0
    return next(d for d in range(-start, 1) if (x == x.round(d)).all())


@FEW
@given(st.lists(st.integers(-10**6, 10**6), min_size=1, max_size=6), st.sampled_from([1, 100, 0.01, 0.001]))
def test_rounding_digits(spark, whole, scale):
    values = [w * scale if scale >= 1 else round(w * scale, 3) for w in whole]
    assert learnt_digits(spark, values) == numpy_digits(values)


def test_rounding_none_and_infinite(spark):
    assert learnt_digits(spark, [1 / 3]) is None
    assert learnt_digits(spark, [100.0, math.inf]) == -2


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=20))
def test_numeric_round_trip_with_nulls(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    e = N.NumericEncoder().fit(df, "x")
    back = {r["i"]: r["x"] for r in e.reverse_transform(e.transform(df, "x"), "x").collect()}
    assert e.is_composition_identity and back == dict(enumerate(values))


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    e = N.NumericEncoder().fit(df, "x")
    assert e.null.nulls and e.null.value == 2.0
    assert sorted(r["x__is_null"] for r in e.transform(df, "x").collect()) == [0.0, 0.0, 1.0]


def test_all_null_and_empty_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert N.NumericEncoder().fit(df, "x").null.value == 0
    empty = spark.createDataFrame([], "x double, c string")
    t = TableEncoder().fit(empty)
    assert t.transform(empty).count() == 0 and t.reverse_transform(t.transform(empty)).columns == ["x", "c"]


def test_one_category(spark):
    df = spark.createDataFrame([("a",), ("a",)], "c string")
    for e in (CategoricalEncoder(), OneHotEncoder(), LabelEncoder()):
        assert [r["c"] for r in e.fit(df, "c").reverse_transform(e.transform(df, "c"), "c").collect()] == ["a", "a"]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r[0] for r in N.StandardEncoder().fit_transform(df, "x").collect()] == [0.0, 0.0]


def test_datetime_before_1970_and_leap_day(spark):
    df = spark.sql("select timestamp_ntz'1904-02-29 12:00:00' t union all select timestamp_ntz'2020-02-29 00:00:01' union all select null")
    e = N.DatetimeRoundedEncoder().fit(df, "t")
    assert e.divider == 1_000_000
    assert sorted(map(str, e.reverse_transform(e.transform(df, "t"), "t").collect())) == sorted(map(str, df.collect()))


def test_unfitted_missing_and_unknown(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    with pytest.raises(NotFittedError):
        OneHotEncoder().transform(df, "c")
    with pytest.raises(KeyError):
        OneHotEncoder().fit(df, "nope")
    e = OneHotEncoder(error_on_unknown=True).fit(df.where("c = 'a'"), "c")
    assert e.transform(df.withColumnRenamed("c", "d"), "c").columns == ["d"]
    with pytest.raises(Exception, match="unknown category"):
        e.transform(df, "c").collect()
    assert OneHotEncoder(limit=1).fit(df, "c").get_output_types() == {"value": "sparse"}


def test_name_collision_and_prefix(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, x__value double")
    out = N.StandardEncoder().fit_transform(df, "x")
    assert out.columns == ["x__value", "x#__value"]
    assert field_prefix(["a", "b"]) == "a#b"
    assert dotted_names(out.select("x__value")).columns == ["x.value"]


def test_label_unknown_is_null(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    e = LabelEncoder().fit(df, "c")
    assert e.transform(spark.createDataFrame([("z",)], "c string"), "c").first()[0] is None


def test_types_and_roles(spark):
    df = spark.createDataFrame([(1, [1.0])], "a int, b array<double>")
    with pytest.raises(TypeError, match="'b'"):
        infer_types(df)
    with pytest.raises(KeyError):
        ColumnRoles(continuous=("zz",)).check(df)
    with pytest.raises(TypeError):
        ColumnRoles(continuous=("b",)).check(df)


def test_table_settings_unfit(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, c string")
    t = TableEncoder({"c": OneHotEncoder()}).fit(df)
    assert t.final_outputs == ["n__value", "c__value0", "c__value1"]
    assert sorted(map(str, t.reverse_transform(t.transform(df)).collect())) == sorted(map(str, df.collect()))
    assert "OneHotEncoder" in t.lineage_yaml()
    t.update_data_types({"n": "categorical"})
    with pytest.raises(NotFittedError):
        t.transform(df)


def test_registry(spark):
    assert isinstance(make("one_hot"), OneHotEncoder)
    with pytest.raises(KeyError):
        make("nothing")


def test_normal_functions(spark):
    p = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.9999]
    df = with_normal_cdf(with_normal_ppf(spark.createDataFrame([(x,) for x in p], "p double"), {"z": "p"}), {"q": "z"})
    for r in df.collect():
        assert r["q"] == pytest.approx(r["p"], rel=1e-8)
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("family", ["gaussian", "gamma", "beta", "student_t", "gaussian_kde", "truncated_gaussian"])
def test_copula_round_trip(spark, family):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "x": rng.gamma(3.0, 2.0, 500)}))
    e = CopulaEncoder(distribution=family).fit(df, "x")
    back = e.reverse_transform(e.transform(df, "x"), "x").toPandas().merge(df.toPandas(), on="i")
    inner = back[(back.x_y > back.x_y.quantile(0.02)) & (back.x_y < back.x_y.quantile(0.98))]
    assert (inner.x_x - inner.x_y).abs().max() < 0.02


@pytest.mark.parametrize("far", [999_999.0, -999_999.0])
def test_copula_with_a_far_value(spark, far):
    x = np.append(np.random.default_rng(0).uniform(0, 10, 3000), far)
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(x)), "x": x}))
    e = CopulaEncoder(distribution="gaussian_kde").fit(df, "x")
    assert e.distances["gaussian_kde"] < 0.06
    back = e.reverse_transform(e.transform(df, "x"), "x").toPandas().merge(df.toPandas(), on="i")
    inner = back[(back.x_y > 0.5) & (back.x_y < 9.5)]
    assert len(inner) > 2000 and (inner.x_x - inner.x_y).abs().max() < 0.05


def test_copula_selection(spark):
    assert candidates("parametric_bounded") == ["beta", "truncated_gaussian"]
    with pytest.raises(TypeError):
        candidates("weird")
    df = spark.createDataFrame(pd.DataFrame({"x": np.random.default_rng(0).normal(10, 2, 2000)}))
    assert CopulaEncoder(distribution="parametric").fit(df, "x").family in ("gaussian", "student_t")


def test_mixture_finds_modes_and_prunes(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(50, 2, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    rows = fit_mixtures(df, {"x": F.col("x")}).collect()
    assert sum(r["weight"] for r in rows) == pytest.approx(1.0)
    big = sorted((r["mean"], r["weight"]) for r in rows if r["weight"] > 0.005)
    assert min(abs(m - 50) for m, _ in big) < 1 and min(abs(m) for m, _ in big) < 1
    assert len(big) < 10
    again = fit_mixtures(df.repartition(5), {"x": F.col("x")}).collect()
    assert np.allclose(sorted(r["mean"] for r in rows), sorted(r["mean"] for r in again), atol=1e-6)


def test_one_far_value_leaves_the_modes_alone(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 6000), rng.normal(10, 1, 4000)])
    found = []
    for values in (x, np.append(x, 999_999.0)):
        df = spark.createDataFrame(pd.DataFrame({"x": values}))
        assert binned_points(df, {"x": F.col("x")}).agg(F.sum("n")).first()[0] == len(values)
        rows = fit_mixtures(df, {"x": F.col("x")}).collect()
        found.append(sorted((r["mean"], r["std"], r["weight"]) for r in rows if r["weight"] > 0.005))
    assert len(found[0]) == len(found[1]) == 2
    assert np.allclose(found[0], found[1], atol=0.02)
    assert np.allclose(found[0], [(0, 1, 0.6), (10, 1, 0.4)], atol=0.05)


def test_mixture_on_a_constant():
    weight, mean, std, _ = fit_points(np.array([10.0]), np.array([0.0]), np.array([0.0]), 4)
    assert np.isfinite(weight).all() and np.isfinite(std).all()
