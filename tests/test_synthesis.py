import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.fidelity.marginal import chi_square_tail, ks
from tabloom.fidelity.pairwise import correlation_rmse, kl_continuous
from tabloom.fidelity.row import METRICS, metric_row
from tabloom.operators import categorical
from tabloom.plans.flat import FlatEncoder
from tabloom.roles import ColumnRoles
from tabloom.runs.experiment import ALL_METRICS, Experiment, Settings
from tabloom.sources import generators as G
from tabloom.sources import io
from tabloom.streaming import jobs
from tabloom.synthesis import network as N
from tabloom.synthesis import train as T
from tabloom.synthesis.copula import GaussianCopula
from tabloom.synthesis.sample import constrained

ROLES = ColumnRoles(categorical=("l_returnflag",), continuous=("l_quantity", "l_extendedprice"))


@pytest.fixture(scope="module")
def toy():
    shape = N.Shape([3, 2], 2, latent=2, hidden=4, decoder_hidden=3)
    p = N.initial(shape, 0)
    p["logsigma"] = np.array([0.2, -0.3])
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(3)[rng.integers(0, 3, 6)], np.eye(2)[rng.integers(0, 2, 6)], rng.normal(size=(6, 2))], axis=1)
    return shape, p, x, rng.normal(size=(6, 2))


def total(p, shape, x, noise):
    (kl, cat, num), _ = N.row_losses(p, shape, x, noise)
    return (kl - cat - num).sum()


def test_gradient_by_finite_differences(toy):
    shape, p, x, noise = toy
    grads, _ = N.gradient(p, shape, x, noise)
    flat, g = N.pack(p), N.pack(grads)
    for i in np.random.default_rng(0).choice(len(flat), 25, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (total(N.unpack(flat + step, p), shape, x, noise) - total(N.unpack(flat - step, p), shape, x, noise)) / 2e-6
        assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("c", [0.5, 1e6])
def test_clipped_gradient_equals_row_by_row(toy, c):
    shape, p, x, noise = toy
    grads, _ = N.gradient(p, shape, x, noise, clip=c)
    want = 0
    for i in range(len(x)):
        g = N.pack(N.gradient(p, shape, x[i:i + 1], noise[i:i + 1])[0])
        want = want + g * min(1, c / (np.linalg.norm(g) + 1e-6))
    assert np.allclose(N.pack(grads), want, atol=1e-9)


def test_distributed_sum_equals_local(spark, toy):
    shape, p, x, _ = toy
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_key bigint, features array<double>")
    noise = N.hashed_normal(np.arange(len(x)), shape.latent, 9)
    want = N.pack(N.gradient(p, shape, x, noise)[0])
    for parts in (1, 4):
        n, _, got = T.summed_gradient(df.repartition(parts), T.Model(shape, p), spark.sparkContext.broadcast(p), 9, None)
        assert n == len(x) and np.allclose(got, want, atol=1e-9)


@pytest.fixture(scope="module")
def lines(spark, data):
    return spark.read.parquet(f"{data}/lineitem.parquet").withColumn("row_key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))


def test_training_improves_and_stops(spark, lines):
    e = FlatEncoder(ROLES, keep=("row_key",)).fit(lines)
    rows = e.encode_vector(lines)
    shape = N.Shape(e.widths, 2, latent=2, hidden=8, decoder_hidden=8)
    model = T.fit(rows, shape, epochs=3, q=0.25, seed=2, rate=0.02, patience=5)
    assert model.log[-1][1] < model.log[0][1] and len(model.log) == 3
    stopped = T.fit(rows, shape, epochs=3, q=0.5, seed=2, patience=1)
    assert stopped.stopped_at == 1
    made = T.generate(spark, model, 50, seed=3)
    assert made.exceptAll(T.generate(spark, model, 50, seed=3).repartition(3)).isEmpty()
    decoded = e.decode(e.from_vector(made, keep=("id",)))
    assert decoded.columns == ["id", *ROLES.columns()]
    make = lambda start, n: e.decode(e.from_vector(T.generate(spark, model, n, 3, start), keep=("id",)))
    kept = constrained(make, [F.col("l_quantity") > 10], 500)
    assert kept.count() == 500 and kept.where("l_quantity <= 10").isEmpty()
    path = io.scratch(spark, "m")
    io.save_model(spark, model.params, path, {"widths": shape.widths})
    params, state = io.load_model(spark, path)
    assert state == {"widths": shape.widths} and all((params[k] == v).all() for k, v in model.params.items())


def test_private_training_reports_epsilon(lines):
    e = FlatEncoder(ROLES, keep=("row_key",)).fit(lines)
    shape = N.Shape(e.widths, 2, latent=2, hidden=4, decoder_hidden=4)
    seen = []
    model = T.fit(e.encode_vector(lines), shape, epochs=1, q=0.5, clip=1.0, target_epsilon=4.0, target_delta=1e-5,
                  observer=seen.append)
    assert len(seen) == 2 and all(s["gradient_norm"] <= s["rows"] for s in seen)
    assert 0 < model.epsilon <= 4.0


def test_copula_keeps_marginals(spark, lines):
    model = GaussianCopula(ROLES, "parametric", ["row_key"]).fit(lines)
    made = model.sample(spark, 6000, seed=1)
    scores = {r["column"]: r["score"] for r in ks(lines, made, list(ROLES.continuous)).collect()}
    assert min(scores.values()) > 0.85
    low, high = lines.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    assert made.where(~F.col("l_quantity").between(low, high)).isEmpty()


def test_copula_of_many_categories_equals_that_of_few(spark, monkeypatch):
    rows = [(i, ("a", "b", "c", None)[min(3, i % 7)], float(min(3, i % 7) + i % 3)) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, c string, x double")
    roles = ColumnRoles(categorical=("c",), continuous=("x",))
    small = GaussianCopula(roles, "gaussian", ["k"]).fit(df)
    assert small.normal_scores(df).distinct().count() > 600
    monkeypatch.setattr(categorical, "LITERAL_LIMIT", -1)
    large = GaussianCopula(roles, "gaussian", ["k"]).fit(df)
    assert not large.encoders["c"].cats.small and np.allclose(large.matrix, small.matrix, atol=1e-9)
    scores = [sorted(tuple(r) for r in m.normal_scores(df).collect()) for m in (small, large)]
    assert np.allclose(*scores)
    with pytest.raises(ValueError):
        GaussianCopula(roles)


def test_identical_tables_score_one(lines):
    cols = list(ROLES.continuous)
    assert all(r["score"] == 1.0 for r in ks(lines, lines, cols).collect())
    assert all(r["score"] == pytest.approx(1.0) for r in kl_continuous(lines, lines, cols).collect())
    assert correlation_rmse(lines, lines, cols).first()["rmse"] == 0.0


def test_chi_square_tail():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert chi_square_tail(0.0, 3) == 1.0


def test_metric_row_by_name(lines):
    roles = ColumnRoles(categorical=("l_returnflag", "l_linestatus"), continuous=ROLES.continuous)
    row = metric_row(lines, lines, roles, ["CSTest", "KSTest"], gower=True).first()
    assert row["CSTest"] > 0.99 and row["KSTest"] == 1.0
    with pytest.raises(KeyError):
        metric_row(lines, lines, roles, ["Nope"])
    assert {"SVCDetection", "GMLogLikelihood", "KSTestExtended"} <= set(METRICS)


def test_generators_and_demo(spark):
    assert len(G.GENERATORS) == 36
    assert {k: len(G.by_type(k)) for k in ("boolean", "categorical", "datetime", "numerical")} == {
        "boolean": 6, "categorical": 14, "datetime": 6, "numerical": 10}
    assert G.generate(spark, "normal_nans", 100).where("value is null").count() > 0
    demo = G.demo_table(spark, 50)
    assert [demo.where(F.col(f"`{c}`").isNull()).count() for c in demo.columns] == [10] * 4


def test_stream_of_an_encoder_equals_batch(spark, data):
    from tabloom.operators.table import TableEncoder
    batch = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    t = TableEncoder(keep=("o_orderkey",)).fit(batch)
    stream = jobs.table_stream(spark, f"{data}/[o]rders.parquet").select(*batch.columns)
    got = jobs.run_to_files(jobs.encode_stream(stream, t), spark, "t")
    assert got.exceptAll(t.transform(batch)).isEmpty() and got.count() == batch.count()


def test_an_experiment_goes_on_where_it_stopped(spark, lines, monkeypatch):
    df = lines.where("l_orderkey < 200").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    roles = ColumnRoles(categorical=("l_returnflag", "l_linestatus"), continuous=("l_quantity", "l_tax"), datetime=("l_shipdate",))
    small = Settings(latent=2, hidden=4, decoder_hidden=4, epochs=1, q=0.5, clip=1.0, sigma=1.0)
    path = io.scratch(spark, "experiment")
    make = lambda: Experiment(df, roles, "row_key", path, small, [F.col("l_quantity") > 0], rows=300)

    monkeypatch.setattr("tabloom.runs.experiment.metric_row", lambda *a: 1 / 0)  # dies after the rows of the first seed
    with pytest.raises(ZeroDivisionError):
        make().run([1, 2])
    monkeypatch.undo()
    trained = []
    plain = T.fit
    monkeypatch.setattr(T, "fit", lambda *a, **k: trained.append(k["seed"]) or plain(*a, **k))
    first = make()
    got = first.run([1, 2]).orderBy("seed").collect()
    assert trained == [2]  # the first seed's model was complete
    assert [r["seed"] for r in got] == [1, 2] and all(r[n] is not None for r in got for n in (*ALL_METRICS, "Gower", "epsilon"))
    assert len(ALL_METRICS) == 7 and set(first.logs([1, 2]).columns) >= {"seed", "elbo"}
    again = make().run([1, 2]).orderBy("seed").collect()
    assert again == got and trained == [2]
    made = first.synthetic(1)
    assert made.count() == 300 and made.where("l_quantity <= 0").isEmpty() and set(roles.columns()) <= set(made.columns)
    assert first.ledger.commits() == ["seed-1-0", "seed-2-0"]
    with pytest.raises(ValueError, match="other settings"):
        Experiment(df, roles, "row_key", path, Settings(epochs=3))


def test_the_best_parameters_are_used(spark, toy):
    shape, p, x, _ = toy
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_key bigint, features array<double>")
    zero = {k: np.zeros_like(v) for k, v in p.items()}
    means = lambda m: [r["mu"] for r in T.encode(rows, m).orderBy("row_key").collect()]
    assert means(T.Model(shape, zero, best=p)) == means(T.Model(shape, p)) != means(T.Model(shape, zero))


def test_late_rows_are_dropped_and_counted(spark):
    """Four micro-batches; a row of the last one is late if its hour had ended before the watermark of the second."""
    rows = [(f"k{i}", f"2024-01-01 {h:02d}:10:00", 1.0, b) for b, hours in enumerate([(0, 3), (6, 9), (12, 15), (1, 4, 18, 21)])
            for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "name string, t string, v double, b int").withColumn("t", F.to_timestamp("t"))
    path = jobs.in_arrivals(df, F.col("b"), 4, io.scratch(spark, "arrivals"))
    stream = jobs.table_stream(spark, path).select("name", "t", "v")
    got, batches, late = jobs.run_counting(jobs.thin_stream(stream, ["name"], "t", "v", "1 hour", "2 hours"), spark, "late")
    hours = sorted(r["window_start"].hour for r in got.collect())
    assert batches == 4 and late == 2 and hours == [0, 3, 6, 9, 12, 15, 18]


def test_a_stream_is_decoded_by_the_table_of_cells(spark, monkeypatch):
    from tabloom.operators.table import TableEncoder
    monkeypatch.setattr(categorical, "LITERAL_LIMIT", -1)
    df = spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("c"), F.col("id") % 40)).alias("c"), (F.col("id") * 1.5).alias("x"))
    t = TableEncoder(keep=("id",)).fit(df)
    path = io.scratch(spark, "coded")
    t.transform(df).repartition(3).write.parquet(path)
    back = jobs.run_to_files(jobs.decode_stream(jobs.table_stream(spark, path), t), spark, "decoded")
    assert back.exceptAll(df).isEmpty() and back.count() == 300
