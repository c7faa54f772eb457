"""The variational network and the copula trained on lineitem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tabloom.fidelity.row import metric_row
from tabloom.plans.flat import FlatEncoder
from tabloom.roles import ColumnRoles
from tabloom.runs.experiment import Experiment, Settings
from tabloom.runs.summary import multi_run as run_seeds
from tabloom.session import together
from tabloom.sources import io
from tabloom.synthesis import network as N
from tabloom.synthesis import train as T
from tabloom.synthesis.copula import GaussianCopula
from tabloom.synthesis.sample import categorical_draw, constrained

from .base import LINE_NUMERIC, given_u, load, query, r, sql_r, sql_u

ROLES = ColumnRoles(categorical=("l_returnflag", "l_linestatus"), continuous=tuple(LINE_NUMERIC))
RATE = 0.1
_fitted: dict = {}


def encoded(spark, d):
    """Encoder and (row_key, features) of the whole lineitem table."""
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    df = load(spark, d, "lineitem").withColumn("row_key", key)
    e = FlatEncoder(ROLES, "standard", keep=("row_key",)).fit(df)
    return e, e.encode_vector(df)


def trained(spark, d):
    """A briefly trained model, fitted once per table and session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _fitted:
        e, rows = encoded(spark, d)
        shape = N.Shape(e.widths, len(e.continuous_outputs), latent=4, hidden=16, decoder_hidden=16)
        _fitted[at] = (e, T.fit(rows, shape, epochs=2, q=RATE, seed=1, rate=0.01))
    return _fitted[at][0], _fitted[at][1], encoded(spark, d)[1]


@query("vae_fit_log")
def vae_fit_log(spark, d):
    return trained(spark, d)[1].log_table(spark)


@query("vae_fit_private")
def vae_fit_private(spark, d):
    e, rows = encoded(spark, d)
    shape = N.Shape(e.widths, len(e.continuous_outputs), latent=4, hidden=16, decoder_hidden=16)
    model = T.fit(rows, shape, epochs=1, q=RATE, seed=1, rate=0.01, clip=1.0, target_epsilon=5.0)
    return model.log_table(spark).withColumn("epsilon", F.lit(model.epsilon))


@query("vae_encode")
def vae_encode(spark, d):
    _, model, rows = trained(spark, d)
    return T.encode(rows, model)


@query("vae_reconstruct")
def vae_reconstruct(spark, d):
    _, model, rows = trained(spark, d)
    return T.reconstruct(rows, model)


@query("vae_elbo")
def vae_elbo(spark, d):
    _, model, rows = trained(spark, d)
    return T.score(rows, model).agg(*[F.sum(c).alias(c) for c in ("elbo", "kl", "cat", "num")], F.count(F.lit(1)).alias("rows"))


@query("vae_generate")
def vae_generate(spark, d):
    e, model, rows = trained(spark, d)
    made = T.generate(spark, model, rows.count(), seed=5)
    return e.decode(e.from_vector(made, keep=("id",)))


# --- the network with given parameters, in SQL layer by layer -----------------------

GIVEN_SHAPE = N.Shape([3, 2], len(LINE_NUMERIC), latent=2, hidden=3, decoder_hidden=3)


def given_parameters() -> dict:
    """Weights and biases by rule, small multiples of a tenth."""
    out = {}
    for k, (name, (i, o)) in enumerate(GIVEN_SHAPE.layers().items()):
        out[f"{name}.w"] = np.array([[((7 * a + 3 * b + k) % 11 - 5) / 10 for b in range(i)] for a in range(o)])
        out[f"{name}.b"] = np.array([((5 * a + k) % 7 - 3) / 10 for a in range(o)])
    return {**out, "logsigma": np.zeros(GIVEN_SHAPE.continuous)}


def layer_sql(source: str, name: str, inputs: list[str], outputs: list[str], bent: bool) -> str:
    """One dense layer over columns; the row's keys stay."""
    w, b = given_parameters()[f"{name}.w"], given_parameters()[f"{name}.b"]
    sums = [" + ".join([f"{float(b[o])!r}::DOUBLE", *(f"{float(w[o, i])!r}::DOUBLE * {x}" for i, x in enumerate(inputs))]) for o in range(len(outputs))]
    cells = ", ".join(f"tanh({s}) AS {n}" if bent else f"{s} AS {n}" for s, n in zip(sums, outputs))
    return f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {cells} FROM {source})"


def chain_sql(source: str, names: str, inputs: list[str], last: list[str]) -> str:
    for k in range(3):
        outputs = last if k == 2 else [f"{names}{k}_{i}" for i in range(3)]
        source = layer_sql(source, f"{names}{k}", inputs, outputs, k < 2)
        inputs = outputs
    return source


X = [f"x{i}" for i in range(GIVEN_SHAPE.size)]
X_SQL = [*(f"(l_returnflag = '{v}')::INTEGER::DOUBLE" for v in "ANR"), *(f"(l_linestatus = '{v}')::INTEGER::DOUBLE" for v in "FO"),
         *(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::FLOAT::DOUBLE" for c in LINE_NUMERIC)]
ROWS_SQL = f"(SELECT *, {', '.join(f'{s} AS {x}' for s, x in zip(X_SQL, X))} FROM lineitem)"
CODE = ["mu0", "mu1", "s0", "s1"]
CODE_SQL = chain_sql(ROWS_SQL, "e", X, CODE)
GIVEN_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def given_rows(spark, d):
    """The encoded table under a dense row key, the keys by that key, and the model with the given parameters."""
    df = load(spark, d, "lineitem").select(*GIVEN_KEYS, "l_suppkey", *ROLES.columns())
    key = F.xxhash64(*GIVEN_KEYS, "l_suppkey", "l_extendedprice")
    keyed = df.withColumn("row_key", key)
    e = FlatEncoder(ROLES, "standard", keep=("row_key",)).fit(keyed)
    return e.encode_vector(keyed), keyed.select("row_key", *GIVEN_KEYS), T.Model(GIVEN_SHAPE, given_parameters())


@query("vae_encode_given", f"SELECT {', '.join(GIVEN_KEYS)}, {', '.join(f'{sql_r(c, 5)} AS {c}' for c in CODE)} FROM {CODE_SQL}")
def vae_encode_given(spark, d):
    rows, keys, model = given_rows(spark, d)
    both = F.concat("mu", "logsigma")
    return T.encode(rows, model).join(keys, "row_key").select(*GIVEN_KEYS, *[r(F.get(both, i), 5).alias(c) for i, c in enumerate(CODE)])


@query("vae_reconstruct_given", f"SELECT {', '.join(GIVEN_KEYS)}, {', '.join(f'{sql_r(x, 5)} AS {x}' for x in X)} FROM {chain_sql(CODE_SQL, 'd', CODE[:2], X)}")
def vae_reconstruct_given(spark, d):
    rows, keys, model = given_rows(spark, d)
    return T.reconstruct(rows, model).join(keys, "row_key").select(*GIVEN_KEYS, *[r(F.get("features", i), 5).alias(x) for i, x in enumerate(X)])


def made_rows(spark, e, model):
    return lambda start, n: e.decode(e.from_vector(T.generate(spark, model, n, seed=5, start=start), keep=("id",)))


@query("synth_constrained")
def synth_constrained(spark, d):
    e, model, rows = trained(spark, d)
    rules = [F.col("l_quantity") > 0, F.col("l_extendedprice") > 0]
    return constrained(made_rows(spark, e, model), rules, rows.count())


LOGITS = ["l_quantity / 10", "l_linenumber", "l_discount * 20"]
U = sql_u("l_orderkey * 7 + l_linenumber", 12)


@query("categorical_draw", f"""
SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN a > u * (a + b + c) THEN 0 WHEN a + b > u * (a + b + c) THEN 1 ELSE 2 END)::INTEGER AS drawn
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {U} AS u, exp({LOGITS[0]}) AS a, exp({LOGITS[1]}) AS b, exp({LOGITS[2]}) AS c FROM lineitem)""")
def categorical_draw_query(spark, d):
    logits = F.array(F.col("l_quantity") / 10, F.col("l_linenumber").cast("double"), F.col("l_discount") * 20)
    u = given_u(F.col("l_orderkey") * 7 + F.col("l_linenumber"), 12)
    staged = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", logits.alias("l"), u.alias("u"))
    return staged.select("l_orderkey", "l_linenumber", "l_partkey", categorical_draw(F.col("l"), F.col("u")).alias("drawn"))


COPULA_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("copula_synth")
def copula_synth(spark, d):
    df = load(spark, d, "lineitem")
    model = GaussianCopula(ROLES, "parametric", COPULA_KEYS).fit(df)
    return model.sample(spark, df.count(), seed=3)


# normal scores of Gaussian marginals are linear in the column, so their correlation is the column's
@query("copula_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {sql_r(f'corr({a}, {b})')} AS corr FROM lineitem"
    for a in LINE_NUMERIC for b in LINE_NUMERIC))
def copula_corr(spark, d):
    model = GaussianCopula(ColumnRoles(continuous=tuple(LINE_NUMERIC)), "gaussian").fit(load(spark, d, "lineitem"))
    rows = [(a, b, float(model.matrix[i, j])) for i, a in enumerate(model.columns) for j, b in enumerate(model.columns)]
    return spark.createDataFrame(rows, "column_a string, column_b string, corr double").withColumn("corr", r(F.col("corr")))


@query("multi_run")
def multi_run(spark, d):
    df = load(spark, d, "lineitem").select(*COPULA_KEYS, *ROLES.columns())
    model = GaussianCopula(ROLES, "gaussian", COPULA_KEYS).fit(df)
    n = df.count()
    return run_seeds([1, 2, 3], lambda s: metric_row(df, model.sample(spark, n, seed=s), ROLES, ["KSTest", "DiscreteKLDivergence"]))


@query("experiment")
def experiment(spark, d):
    """A seed of plain and one of private training, through all stages and all eight metrics."""
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    df = load(spark, d, "lineitem").withColumn("row_key", key)
    rules = [F.col("l_quantity") > 0, F.col("l_extendedprice") > 0]
    plain = Settings(latent=4, hidden=16, decoder_hidden=16, epochs=2, q=RATE, rate=0.01)
    private = Settings(latent=4, hidden=16, decoder_hidden=16, epochs=1, q=RATE, rate=0.01, clip=1.0, target_epsilon=5.0)
    parts = together([lambda s=s: Experiment(df, ROLES, "row_key", io.scratch(spark, "experiment"), s, rules).run([1]) for s in (plain, private)])
    return parts[0].withColumn("private", F.lit(False)).unionByName(parts[1].withColumn("private", F.lit(True)))


@query("model_roundtrip")
def model_roundtrip(spark, d):
    _, model, _ = trained(spark, d)
    path = io.scratch(spark, "model")
    io.save_model(spark, model.params, path, {"widths": model.shape.widths, "latent": model.shape.latent})
    params, _ = io.load_model(spark, path)
    rows = [(k, int(v.size), bool((params[k] == v).all())) for k, v in sorted(model.params.items())]
    return spark.createDataFrame(rows, "name string, size int, equal boolean")
