import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.fidelity import bins, distance, learned, marginal
from tabloom.functions import scalar, sums
from tabloom.roles import ColumnRoles
from tabloom.runs.experiment import Experiment, Settings
from tabloom.sources import io
from tabloom.synthesis import train as T
from tabloom.synthesis.copula import GaussianCopula


def table(spark, seed, n, shift):
    """Close values, few values, signs, a far value, and missing ones."""
    rng = np.random.default_rng(seed)
    rows = [(float(a) + shift, float(b), float(c), None if d > 2 else float(np.round(d, 1))) for a, b, c, d in zip(
        rng.normal(1e6, 3, n), rng.integers(0, 5, n), np.append(rng.normal(0, 1, n - 1), 1e300), rng.normal(0, 1, n))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double")


def plain_ks(x, y):
    at = np.union1d(x, y)
    return np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y)).max()


@pytest.mark.parametrize("few", [False, True])
def test_ks_and_gower_equal_brute_force(spark, monkeypatch, few):
    if few:  # bins in which nearly all values are inside, blocks of a few rows
        monkeypatch.setattr(bins, "BINS", 8)
        monkeypatch.setattr(marginal, "BINS", 8)
    real, made = table(spark, 1, 400, 0.0), table(spark, 2, 300, 1.5)
    columns = real.columns
    x, y = (t.toPandas() for t in (real, made))
    got = {r["column"]: r["distance"] for r in marginal.ks(real, made, columns).collect()}
    assert got == pytest.approx({c: plain_ks(x[c].dropna(), y[c].dropna()) for c in columns})
    pairs = {}
    for c in columns:
        a, b = x[c].dropna().to_numpy(), y[c].dropna().to_numpy()
        pairs[c] = np.abs(a[:, None] - b).mean() / (max(a.max(), b.max()) - min(a.min(), b.min()))
    monkeypatch.setattr(bins, "BLOCK_ROWS", 100)  # some columns are left to the order of all values
    found = distance.gower_features(real, made, columns, []).collect()
    assert {r["column"]: r["distance"] for r in found} == pytest.approx(pairs)


def test_ks_beyond_the_real_extremes(spark):
    real = spark.range(1000).select((F.col("id") % 10 + 1.0).alias("x"))
    made = spark.range(1000).select((F.col("id") / 50.0 - 3).alias("x"))
    x, y = (t.toPandas()["x"].to_numpy() for t in (real, made))
    assert marginal.ks(real, made, ["x"]).first()["distance"] == pytest.approx(plain_ks(x, y))
    assert marginal.ks(made, real, ["x"]).first()["distance"] == pytest.approx(plain_ks(x, y))
    above = real.withColumn("x", F.col("x") + 10.5 + F.rand(1))
    assert marginal.ks(real, above, ["x"]).first()["distance"] == 1.0


def test_a_mixture_finds_its_components_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal([0, 0], [1, 2], (900, 2)), rng.normal([9, -7], [2, 1], (600, 2))])
    df = spark.createDataFrame(x.tolist(), "u double, v double").repartition(5)
    passes = []
    monkeypatch.setattr(learned, "summed", lambda *a: passes.append(1) or sums.summed(*a))
    models, n = learned.fit_mixture(sums.packed(df), 2, (2, 4), 10, 0)
    assert n == 1500 and len(passes) <= 10  # one for both numbers of components
    two = models[0]
    assert sorted(two.weights) == pytest.approx([0.4, 0.6], abs=0.02)
    assert np.allclose(np.sort(two.means[:, 0]), [0, 9], atol=0.3)


def test_separators_of_all_folds_share_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(float(i % 2), i // 2 % 3, float(v + 2 * (i % 2)), float(w)) for i, (v, w) in enumerate(rng.normal(0, 1, (900, 2)))]
    df = spark.createDataFrame(rows, "label double, fold int, u double, v double").repartition(4)
    passes = []
    monkeypatch.setattr(learned, "summed", lambda *a: passes.append(1) or sums.summed(*a))
    blocks = sums.packed(df)
    models = learned.fit_separators(blocks, 3, 2, 10, 0.01, 4)
    assert len(passes) <= 41 and all(w[0] > 0.5 > abs(w[1]) for w, _ in models)
    p = df.toPandas()
    for k, auc in enumerate(learned.fold_aucs(blocks, models, 4)):
        mine = p[p.fold == k]
        m = mine[["u", "v"]].to_numpy() @ models[k][0]
        yes, no = m[mine.label > 0], m[mine.label == 0]
        assert auc == pytest.approx(((yes[:, None] > no) + 0.5 * (yes[:, None] == no)).mean(), abs=1e-3)


def test_lbfgs_reaches_the_minimum():
    at, f = np.array([1.0, -2.0, 3.0]), np.array([1.0, 10.0, 100.0])
    search = learned.lbfgs(3, 50)
    x = next(search)
    with pytest.raises(StopIteration) as end:
        while True:
            x = search.send((float((f * (x - at) ** 2).sum()), 2 * f * (x - at)))
    assert end.value.value == pytest.approx(at, abs=1e-2)


def test_every_task_has_rows_of_every_batch(spark):
    """From one partition, as from a file with one row group."""
    rows = spark.range(4000).coalesce(1).select(F.col("id").alias("row_key"), F.array(F.lit(1.0), F.rand(1)).alias("features"))
    shape = T.N.Shape([1], 1, latent=1, hidden=2, decoder_hidden=2)
    seen = []
    plain = T.summed_gradient
    try:
        T.summed_gradient = lambda batch, *a: seen.append(batch.groupBy(F.input_file_name()).count().count()) or plain(batch, *a)
        T.fit(rows, shape, 1, 0.25)
    finally:
        T.summed_gradient = plain
    assert len(seen) == 4 and min(seen) >= spark.sparkContext.defaultParallelism


def test_metrics_read_one_written_view(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").withColumn("row_key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    made = Experiment(df.limit(50), ColumnRoles(("l_returnflag",), ("l_tax",)), "row_key", io.scratch(spark, "e"), Settings())
    assert made.view().count() == 50 and io.is_complete(spark, f"{made.path}/view")


def test_values_in_tasks_equal_expressions(spark):
    ids = np.concatenate([np.arange(-50, 3000), [2**62, -2**63, 2**63 - 1]])
    df = spark.createDataFrame([(int(i),) for i in ids], "id bigint")
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.075, 0.5, 0.925, 0.99, 1 - 1e-9]
    z = [-40.0, -37.5, -9.0, -7.08, -1.0, 0.0, 1.0, 7.08, 9.0, 40.0, float("nan")]
    uniform = np.array([[r[0], r[1]] for r in df.select(scalar.keyed_uniform(["id"], 7), scalar.keyed_uniform(["id"], -3)).collect()])
    assert (uniform == scalar.keyed_uniform_values(ids, [7, -3])).all()
    ppf = [r[0] for r in spark.createDataFrame([(v,) for v in p], "v double").select(scalar.normal_ppf(F.col("v"))).collect()]
    cdf = [r[0] for r in spark.createDataFrame([(v,) for v in z[:-1]], "v double").select(scalar.normal_cdf(F.col("v"))).collect()]
    assert scalar.normal_ppf_values(np.array([p, p])) == pytest.approx(np.array([ppf, ppf]), rel=1e-13)
    got = scalar.normal_cdf_values(np.array(z))
    assert np.isnan(got[-1]) and got[:-1] == pytest.approx(cdf, rel=1e-13, abs=1e-320)


def test_sampling_and_correlation_call_no_expression_per_row(spark):
    """Draws, scores and their distribution functions are made batch by batch, and the table is read once for the sums."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "ab"[int(v > 0)], float(v + w)) for i, (v, w) in enumerate(rng.normal(0, 1, (2000, 2)))], "k int, c string, x double")
    model = GaussianCopula(ColumnRoles(("c",), ("x",)), "gaussian", ["k"]).fit(df)
    assert model.encoders["x"].family == "gaussian" and 0.3 < abs(model.matrix[0, 1]) < 0.8
    made = model.sample(spark, 4000, seed=2)
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in (made, model.normal_scores(df))]
    assert all("lambda" not in p and "MapInArrow" in p for p in plans)
    assert made.repartition(3).exceptAll(model.sample(spark, 4000, seed=2)).isEmpty()
    assert made.groupBy("c").count().count() == 2 and abs(made.agg(F.avg("x")).first()[0] - df.agg(F.avg("x")).first()[0]) < 0.1


def test_bins_span_their_numbers():
    for low, high in ((1.0, 2.0), (-5.0, 3.0), (0.0, 1e300), (-1e-300, 0.0), (900.68, 104999.91), (4.0, 4.0), (-np.inf, np.inf)):
        x = np.unique(np.concatenate([[low, high, -1e308, 1e308], np.linspace(max(low, -1e9), min(high, 1e9), 999)]))
        at = bins.placed(x, low, high)
        assert (np.diff(at) >= 0).all() and at.min() >= 0 and at.max() <= bins.BINS + 1
        for b in np.unique(at):
            begin, end = bins.span(b, b, low, high)
            assert (begin <= x[at == b]).all() and (x[at == b] <= end).all()
