"""Saved encoders, wide one-hots, fields of several columns, fronts, scans, top rows, pair sums, ledgers, folds."""

import datetime as dt
import math
import os
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.fidelity import distance, learned, marginal, pairwise
from tabloom.functions import order
from tabloom.operators import categorical as C
from tabloom.operators.copula import CopulaEncoder
from tabloom.operators.encoder import REGISTRY, ColumnEncoder, append, fit_all, register
from tabloom.operators.fields import DatePartsEncoder, JointEncoder
from tabloom.operators.mixture import MixtureEncoder
from tabloom.operators.numeric import NumericEncoder
from tabloom.operators.store import load_encoder, save_encoder
from tabloom.operators.table import TableEncoder
from tabloom.plans.flat import FlatEncoder
from tabloom.privacy.ledger import StoredLedger
from tabloom.roles import ColumnRoles
from tabloom.runs import trials
from tabloom.sources.io import scratch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# saved encoders

ROLES = ColumnRoles(categorical=("c", "few"), continuous=("x",), datetime=("t",))


def wide_table(spark, n=10_000):
    c = F.when(F.col("id") % 50 == 7, None).otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    return spark.range(n).select("id", c.alias("c"), (F.col("id") % 3).alias("few"), (F.col("id") * 0.5).alias("x"),
                                 F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id % 900 as int))").alias("t"))


def test_a_flat_encoder_decodes_in_another_session(spark, tmp_path):
    df = wide_table(spark)
    e = FlatEncoder(ROLES, "standard", keep=("id",)).fit(df)
    save_encoder(spark, e, f"{tmp_path}/e")
    encoded = e.encode(df)
    encoded.write.parquet(f"{tmp_path}/rows")
    e.decode(encoded).write.parquet(f"{tmp_path}/want")
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tabloom.session import get_session
from tabloom.operators.store import load_encoder
s = get_session("other", 2, 4)
e = load_encoder(s, "{tmp_path}/e")
got = e.decode(s.read.parquet("{tmp_path}/rows"))
want = s.read.parquet("{tmp_path}/want")
assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == want.count() == 10000
assert e.widths[0] == 9801 and e.widths[1] == 3
print("same rows")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "same rows" in done.stdout, done.stderr[-2000:]
    back = e.decode(encoded).orderBy("id").first()
    assert (back["c"], back["few"], back["x"], back["t"]) == ("c0", 0, 0.0, dt.datetime(2020, 1, 1))


def test_every_kind_of_column_encoder_is_saved(spark, tmp_path):
    df = spark.sql("select id, cast(id as double) / 7 x, cast(id % 5 as string) c, id % 2 = 0 b, date'2020-02-01' + cast(id as int) d from range(60)")
    made = {"x": [NumericEncoder(rounding="auto", min_value="auto"), MixtureEncoder(selection="argmax", max_clusters=3), CopulaEncoder()],
            "c": [C.CategoricalEncoder(), C.OneHotEncoder(), C.LabelEncoder(), C.SparseOneHotEncoder(), C.OneHotEncoder(limit=2)],
            "b": [REGISTRY["boolean"]()], "d": [REGISTRY["datetime"](strip_constant=True)]}
    for column, encoders in made.items():
        for i, e in enumerate(encoders):
            e.fit(df, column)
            save_encoder(spark, e, f"{tmp_path}/{column}{i}")
            other = load_encoder(spark, f"{tmp_path}/{column}{i}")
            assert type(other) is type(e)
            encoded = e.encode(df, column, column)
            assert rows(other.encode(df, column, column).select(*e.output_columns(column))) == rows(encoded.select(*e.output_columns(column)))
            assert rows(other.decode(encoded, column, column).select("id", column)) == rows(e.decode(encoded, column, column).select("id", column))


def test_saving_says_what_it_cannot_save(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    with pytest.raises(Exception, match="fitted"):
        save_encoder(spark, C.LabelEncoder(), f"{tmp_path}/no")
    with pytest.raises(TypeError, match="column expression"):
        save_encoder(spark, C.CategoricalEncoder(fuzzy=True, u=F.lit(0.5)).fit(df, "c"), f"{tmp_path}/no")
    with pytest.raises(FileNotFoundError):
        load_encoder(spark, f"{tmp_path}/nothing")
    save_encoder(spark, C.LabelEncoder().fit(df, "c"), f"{tmp_path}/yes")
    with pytest.raises(Exception, match="exists"):
        save_encoder(spark, C.LabelEncoder().fit(df, "c"), f"{tmp_path}/yes")
    spark.createDataFrame([(99, "column:label", "{}")], "format int, kind string, state string").write.parquet(f"{tmp_path}/new/state")
    with pytest.raises(ValueError, match="format 99"):
        load_encoder(spark, f"{tmp_path}/new")


def test_an_encoder_by_subclass(spark, tmp_path):
    """An encoder from outside: registered, fitted in the shared pass, used in a table, saved and found again."""
    @register("halved_test")
    class Halved(ColumnEncoder):
        input_type = "numerical"

        def fit_aggs(self, c):
            return {"top": F.max(c)}

        def finish(self, stats, dtype):
            self.top, self.dtype = stats["top"], dtype

        def encode(self, df, column, prefix):
            return append(df, F.col(column) / (2 * self.top), f"{prefix}__value")

        def decode(self, df, prefix, column):
            return append(df, (F.col(f"{prefix}__value") * 2 * self.top).cast(self.dtype), column)

    df = spark.createDataFrame([(1, "a"), (4, "b")], "n int, c string")
    t = TableEncoder({"n": Halved()}).fit(df)
    save_encoder(spark, t, f"{tmp_path}/t")
    again = load_encoder(spark, f"{tmp_path}/t")
    assert [r["n__value"] for r in again.transform(df).orderBy("n__value").collect()] == [0.125, 0.5]
    assert rows(again.reverse_transform(t.transform(df))) == rows(df)
    kept = REGISTRY.pop("halved_test")
    with pytest.raises(KeyError, match="halved_test"):
        load_encoder(spark, f"{tmp_path}/t")
    assert kept is Halved


# wide one-hot

def test_fifty_thousand_categories(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 60_000 != 1, F.concat(F.lit("v"), F.col("id") % 50_000)).alias("c"))
    e = C.OneHotEncoder().fit(df, "c")
    assert e.wide and e.width == 50_001 and e.get_output_types() == {"value": "sparse"}
    encoded = e.encode(df, "c", "c").drop("c")
    assert encoded.where(F.size("c__value") != 1).isEmpty()
    back = e.decode(encoded, "c", "c").select("id", "c")
    assert back.exceptAll(df).isEmpty() and back.count() == 60_000


def test_sparse_equals_dense(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "b")], "id int, c string")
    other = df.unionByName(spark.createDataFrame([(6, "zz")], df.schema))
    dense, sparse = C.OneHotEncoder().fit(df, "c"), C.OneHotEncoder(limit=2).fit(df, "c")
    assert dense.width == sparse.width == 4
    want = dense.encode(other, "c", "c").select("id", F.array(*[F.col(o).cast("double") for o in dense.output_columns("c")]).alias("v"))
    encoded = sparse.encode(other, "c", "c")
    assert rows(encoded.select("id", C.sparse_to_dense(F.col("c__value"), 4).alias("v"))) == rows(want)
    vectors = C.sparse_vectors(encoded, "c__value", 4, "v")
    assert rows(vectors.select("id", vector_to_array("v").alias("v"))) == rows(want)
    scores = spark.createDataFrame([(1, [0.1, 0.7, 0.2, 0.0]), (2, [0.5, 0.5, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 0.0]), (4, None)], "id int, v array<double>")
    columns = dense.output_columns("c")
    by_dense = dense.decode(scores.where("v is not null").select("id", *[F.get("v", i).alias(o) for i, o in enumerate(columns)]), "c", "c")
    by_sparse = sparse.decode(scores.select("id", C.dense_to_sparse(F.col("v")).alias("c__value")), "c", "c")
    assert rows(by_sparse.select("id", "c")) == rows(by_dense.select("id", "c").union(spark.createDataFrame([(4, None)], "id int, c string")))
    strict = C.OneHotEncoder(limit=2, error_on_unknown=True).fit(df, "c")
    with pytest.raises(Exception, match="unknown category"):
        strict.encode(other, "c", "c").collect()


def test_wide_blocks_in_vectors(spark):
    df = wide_table(spark, 1500)
    e = FlatEncoder(ROLES, "standard", keep=("id",)).fit(df)
    assert e.widths == [1471, 3] and len(e.columns) == 1 + 3 + 2
    vectors = e.encode_vector(df)
    assert {len(r["features"]) for r in vectors.select("features").limit(5).collect()} == {1471 + 3 + 2}
    back = e.decode(e.from_vector(vectors, keep=("id",)))
    assert rows(back.select("id", "c", "few")) == rows(df.select("id", "c", "few"))


# fields of several columns

def test_joint_and_date_fields(spark):
    df = spark.createDataFrame([(1, "a", 1, 2020, 2, 29), (2, "a", None, 2021, 12, 1), (3, None, 1, 1999, 1, 31), (4, "a", 1, 2020, 2, 29)],
                               "id int, p string, q int, y int, m int, d int")
    t = TableEncoder({("p", "q"): JointEncoder(), ("y", "m", "d"): DatePartsEncoder()}, keep=("id",)).fit(df)
    out = t.transform(df)
    assert out.columns == ["id", "p#q__value__value", "y#m#d__value__value"]
    assert [r[1] for r in out.orderBy("id").collect()] == [0.25, 0.875, 0.625, 0.25] or len(set(r[1] for r in out.collect())) == 3
    assert rows(t.reverse_transform(out)) == rows(df)
    assert "p#q" in t.lineage_yaml() and rows(t.lineage(spark))[0][0] == "p#q"
    bad = spark.createDataFrame([(9, "a", 1, 2021, 2, 30)], df.schema)
    assert t.transform(bad).first()["y#m#d__value__value"] is not None  # filled as any missing datetime


def test_fields_of_outputs_and_unfinished_fields(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "y")], "p string, q string")
    levels = TableEncoder({"p": C.LabelEncoder(), "q": C.LabelEncoder(), ("p__value", "q__value"): JointEncoder()}).fit(df)
    assert levels.transform(df).columns == ["p__value#q__value__value__value"]
    assert rows(levels.reverse_transform(levels.transform(df))) == rows(df)
    with pytest.warns(UserWarning, match="p#nope"):
        alone = TableEncoder({("p", "nope"): JointEncoder()}).fit(df)
    assert alone.transform(df).columns == ["p__value", "q__value"]
    made = JointEncoder().fit(df, ("p", "q"))
    assert rows(made.reverse_transform(made.transform(df, ("p", "q")), ("p", "q")).select("p", "q")) == rows(df)


def test_value_counts_of_all_columns_come_from_one_pass(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "p string, q int")
    calls = []
    monkeypatch.setattr(C, "count_values", lambda *a: calls.append(a))
    together = fit_all(df, {"p": C.CategoricalEncoder(), "q": C.CategoricalEncoder()})
    monkeypatch.undo()
    assert not calls
    for c, e in together.items():
        assert [tuple(r) for r in e.cats.rows] == [tuple(r) for r in C.CategoricalEncoder().fit(df, c).cats.rows]


# fronts

@pytest.mark.parametrize("d, top", [(1, 5), (2, 30), (3, 12), (4, 6)])
@pytest.mark.parametrize("rows", [20, 10_000])
def test_front_by_brute_force(spark, monkeypatch, d, top, rows):
    monkeypatch.setattr(trials, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(d)
    points = rng.integers(0, top, size=(500, d)).astype(float)
    names = [f"m{i}" for i in range(d)]
    df = spark.createDataFrame(pd.DataFrame(points, columns=names).assign(t=range(500)))
    df = df.unionByName(spark.createDataFrame([(*[None] * d, 900), (*[float("nan")] * d, 901)], df.schema))
    want = [i for i, p in enumerate(points) if not any((q >= p).all() and (q > p).any() for q in points)]
    assert sorted(r["t"] for r in trials.pareto_front(df, names).collect()) == want
    assert trials.pareto_front(df.limit(0), names).count() == 0


def test_a_front_of_a_hundred_thousand(spark):
    u = (F.col("id") + 0.5) / 100_000
    front = spark.range(100_000).select("id", u.alias("a"), (1 - u).alias("b"), F.sin(u * 7).alias("c"))
    below = front.select(F.col("id") + 1_000_000, F.col("a") - 1e-7, F.col("b") - 1e-7, F.col("c") - 1e-7)
    got = trials.pareto_front(front.union(below), ["a", "b", "c"])
    assert got.agg(F.count(F.lit(1)), F.max("id")).first()[:] == (100_000, 99_999)


# scans

def test_scan_of_long_and_short_series(spark):
    r = random.Random(3)
    data = [(s, i, r.uniform(-5, 5)) for s in ("long", None, "x", "y") for i in range(3000 if s == "long" else r.randint(1, 4))]
    data += [(f"s{k}", i, r.uniform(-5, 5)) for k in range(300) for i in range(r.randint(1, 3))]
    df = spark.createDataFrame(data, "s string, t int, v double")
    want = {}
    for s, i, v in sorted(data, key=lambda x: (str(x[0]), x[1])):
        want[s, i] = 0.1 * v + 0.9 * want.get((s, i - 1), 2.0)
    got = {(x.s, x.t): x.out for x in order.linear_recurrence(df, ["s"], ["t"], "v", 0.9, 2.0, "out").collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_scan_blocks_equal_the_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 70_000):
        for decay in (0.0, 0.5, 0.999, 1.0):
            y, t, want = rng.normal(size=n), 0.0, []
            for v in y:
                t = v + decay * t
                want.append(t)
            assert np.allclose(order.decayed_sums(y, decay), want, rtol=1e-9, atol=1e-9)


# top rows

def test_top_rows_by_composite_keys(spark, monkeypatch):
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), r.randint(0, 9), r.choice([1.5, 2.5, None])) for _ in range(400)] + [("c", 1, 1.0)] * 90
    df = spark.createDataFrame(data, "s string, n int, x double").repartition(5)
    keys = [F.desc("s"), "n", F.asc_nulls_last("x")]
    want = {n: rows(df.orderBy(F.desc("s"), "n", F.asc_nulls_last("x")).limit(n)) for n in (1, 40, 90, 91, 300, 490, 600)}
    monkeypatch.setattr(order, "TOP_LIMIT", 20)
    for n, expected in want.items():
        assert rows(order.top_rows(df, keys, n)) == expected, n
    monkeypatch.setattr(order, "TOP_LIMIT", 0)
    assert rows(order.top_rows(df, keys, 40)) == want[40]
    assert order.top_rows(df.limit(0), keys, 5).count() == 0


def test_numbers_are_a_permutation(spark):
    got = order.numbered(spark.range(1000).repartition(7), "k")
    assert sorted(r["k"] for r in got.collect()) == list(range(1000))


# metrics

def test_correlation_of_gaps_equals_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 1e7
    x[rng.random(x.shape) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(6)]).assign(k=4.0, n=np.nan)
    got = {(r.column_a, r.column_b): r["corr"] for r in pairwise.correlation(spark.createDataFrame(frame), list(frame)).collect()}
    want = frame.corr(min_periods=1)
    assert len(got) == 64
    for (a, b), v in got.items():
        assert v is None if math.isnan(want[a][b]) else abs(v - want[a][b]) < 1e-9, (a, b)


def test_five_hundred_columns(spark):
    df = spark.range(200).select(*[(F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(500)])
    got = pairwise.correlation(df, df.columns)
    assert got.count() == 250_000
    a, b = np.sin(np.arange(200) * 4), np.sin(np.arange(200) * 100)
    one = got.where("column_a = 'c3' and column_b = 'c99'").first()["corr"]
    assert one == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_nan_is_missing_in_every_metric(spark):
    base = [(float(i), float(i % 4)) for i in range(20)]
    with_nan = spark.createDataFrame([*base, (float("nan"), 1.0)], "x double, y double")
    with_null = spark.createDataFrame([*base, (None, 1.0)], "x double, y double")
    real = spark.createDataFrame(base, "x double, y double")
    for metric in (lambda s: marginal.ks(real, s, ["x"]), lambda s: marginal.ks_extended(real, s, ["x", "y"]),
                   lambda s: pairwise.kl_continuous(real, s, ["x", "y"]), lambda s: pairwise.kl_continuous(s, real, ["x", "y"]),
                   lambda s: distance.gower_mean(real, s, ["x"], ["y"]), lambda s: marginal.histogram_numeric(real, s, ["x"]),
                   lambda s: pairwise.correlation(s, ["x", "y"]), lambda s: marginal.histogram_categories(real, s, ["x"])):
        assert rows(metric(with_nan)) == rows(metric(with_null))
    assert marginal.ks(real, with_nan, ["x"]).first()["distance"] == 0


def test_detection_of_few_rows(spark):
    schema = "a double, c string"
    two = spark.createDataFrame([(1.0, "u"), (2.0, "v")], schema)
    got = learned.detection(two, two, ["a", "c"]).collect()
    assert [r["fold"] for r in got] == [0, 1] and all(0 <= r["score"] <= 1 for r in got)
    many = two.unionByName(two).unionByName(two).unionByName(two)  # of two different rows
    assert len(learned.detection(many, many, ["a", "c"]).collect()) == 3
    assert learned.detection(two.limit(1), two, ["a", "c"]).count() == 0


def test_metrics_that_fit_models_after_an_observation(spark, tmp_path):
    """A session that has observed a write cannot be sent to tasks, and neither can a model that holds it."""
    from tabloom.sources.io import write_cohort
    df = spark.sql("select cast(id as double) x, cast(id % 7 as double) y, cast(id % 3 as string) c, concat('k', id % 1200) w from range(1500)")
    assert write_cohort(df, f"{tmp_path}/observed") == 1500
    few = df.limit(60)
    assert len(learned.detection(few, few, ["x", "c"]).collect()) == 3
    assert 0 <= learned.attack_numeric(few, few, ["x"], "y").first()["score"] <= 1
    assert 0 <= learned.attack_categorical(few, few, ["c"], "c").first()["score"] < 0.01
    assert 0 <= learned.attack_categorical(df, df, ["w"], "c").first()["score"] < 0.7  # more categories than one-hot columns


# ledgers

def test_two_sessions_extend_one_ledger(spark):
    path, schema = scratch(spark, "ledger"), "dataset string, q double, sigma double, steps long"
    first = spark.createDataFrame([("a", 0.01, 1.0, 100), (None, 0.02, 2.0, 5)], schema)
    more = spark.createDataFrame([("a", 0.01, 1.0, 50)], schema)
    one, two = StoredLedger(spark, path), StoredLedger(spark.newSession(), path)
    with pytest.raises(FileNotFoundError):
        one.rows()
    assert one.commit("run-1", first) and not two.commit("run-1", first)
    spark._jvm.java.io.File(f"{path}/commit=run-2").mkdirs()  # a write that died
    assert two.commits() == ["run-1"]
    assert two.commit("run-2", more.withColumn("extra", F.lit(1))) and one.commits() == ["run-1", "run-2"]
    with pytest.raises(ValueError):
        one.commit("a/b", more)
    orders = [float(a) for a in range(2, 30)]
    got = {r["dataset"]: r["epsilon"] for r in one.spent(1e-5, orders).collect()}
    whole = spark.createDataFrame([("a", 0.01, 1.0, 150), (None, 0.02, 2.0, 5)], schema)
    single = StoredLedger(spark, scratch(spark, "ledger"))
    single.commit("all", whole)
    assert got == {r["dataset"]: r["epsilon"] for r in single.spent(1e-5, orders).collect()} and len(got) == 2
    assert {r["dataset"]: r["steps"] for r in two.steps().collect()} == {"a": 150, None: 5}
