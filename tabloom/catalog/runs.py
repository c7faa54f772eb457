"""Experiment tables derived from lineitem, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.runs import stats, summary, trials

from .base import given_u, load, query, r, sql_r, sql_u

# every supplier's lines are one run; its metrics are means over them
RUN_METRICS = {"quantity": "l_quantity", "price": "l_extendedprice / 1000", "discount": "l_discount"}
RUNS = f"(SELECT l_suppkey, {', '.join(f'avg({x}) AS {n}' for n, x in RUN_METRICS.items())} FROM lineitem GROUP BY l_suppkey)"


@query("metric_summary", " UNION ALL ".join(
    f"SELECT '{n}' AS metric, {sql_r(f'avg({n})')} AS mean, {sql_r(f'stddev_pop({n})')} AS std, count({n}) AS runs FROM {RUNS}"
    for n in RUN_METRICS))
def metric_summary(spark, d):
    runs = load(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(F.expr(x)).alias(n) for n, x in RUN_METRICS.items()])
    out = summary.metric_summary(runs, list(RUN_METRICS))
    return out.withColumns({c: r(F.col(c)) for c in ("mean", "std")})


# whole-number metrics per part, so that both engines compare exactly
TRIALS = """(SELECT l_partkey AS trial, sum(l_quantity)::BIGINT AS m1, count(*) AS m2,
 sum(round(l_discount * 100)::BIGINT)::BIGINT AS m3 FROM lineitem GROUP BY l_partkey)"""
FRONT = f"""(SELECT * FROM {TRIALS} a WHERE NOT EXISTS (SELECT 1 FROM {TRIALS} b
 WHERE b.m1 >= a.m1 AND b.m2 >= a.m2 AND b.m3 >= a.m3 AND (b.m1 > a.m1 OR b.m2 > a.m2 OR b.m3 > a.m3)))"""
METRICS = ["m1", "m2", "m3"]


def trial_table(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("trial")).agg(
        F.sum("l_quantity").cast("bigint").alias("m1"), F.count(F.lit(1)).alias("m2"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("m3"))


@query("pareto_front", f"SELECT * FROM {FRONT}")
def pareto_front(spark, d):
    return trials.pareto_front(trial_table(spark, d), METRICS)


@query("best_trial", f"""
SELECT trial, m1, m2, m3, {sql_r('(m1 + m2 + m3) / 3.0::DOUBLE')} AS mean_metric FROM {FRONT}
ORDER BY m1 + m2 + m3 DESC, trial LIMIT 1""")
def best_trial(spark, d):
    out = trials.best_trial(trial_table(spark, d), METRICS, "trial")
    return out.withColumn("mean_metric", r(F.col("mean_metric")))


SETTINGS = {"latent": (2, 128, 2, True), "hidden": (32, 1024, 32, True), "rate": (0.001, 0.01, 0.00001, False)}


def setting_sql(i: int, name: str) -> str:
    low, high, step, whole = SETTINGS[name]
    count = int((high - low) / step + 1e-9) + 1
    x = f"{low} + {step}{'' if whole else '::DOUBLE'} * floor({sql_u('o_orderkey', i)} * {count}::DOUBLE)"
    return f"({x})::BIGINT AS {name}" if whole else f"{sql_r(x, 9)} AS {name}"


@query("trial_settings", f"SELECT o_orderkey AS trial, {', '.join(setting_sql(i, n) for i, n in enumerate(SETTINGS))} FROM orders")
def trial_settings(spark, d):
    ids = load(spark, d, "orders").select(F.col("o_orderkey").alias("trial"))
    out = trials.trial_settings(ids, SETTINGS, lambda i: given_u("trial", i))
    return out.withColumn("rate", r(F.col("rate"), 9))


# --- statistic series: one per event type, numbered along the event id ------

STEPS = "(SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS step FROM events)"
THIN = 10


def series(spark, d):
    df = load(spark, d, "events").select("event_type", "event_id", "value")
    return stats.with_steps(df, ["event_type"], "event_id")


def thin_sql(point: str) -> str:
    return f"""SELECT event_type, w AS "window", {sql_r(point)} AS value
FROM (SELECT *, floor(step / {THIN}::DOUBLE)::BIGINT AS w, max(step) OVER (PARTITION BY event_type) AS last FROM {STEPS})
GROUP BY event_type, w, last HAVING last >= (w + 1) * {THIN}"""


@query("stat_thin_avg", thin_sql("avg(value)"))
def stat_thin_avg(spark, d):
    out = stats.thin(series(spark, d), ["event_type"], "step", "value", THIN)
    return out.withColumn("value", r(F.col("value")))


@query("stat_thin_sample", thin_sql("arg_max(value, step)"))
def stat_thin_sample(spark, d):
    out = stats.thin(series(spark, d), ["event_type"], "step", "value", THIN, "sample")
    return out.withColumn("value", r(F.col("value")))


@query("stat_filter", "SELECT event_type, user_id, event_id, value FROM events WHERE event_type = 'click' AND user_id = 7")
def stat_filter(spark, d):
    df = load(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    return stats.select(df, "click", 7, "event_type", "user_id")


# --- training logs: every supplier is a run, every month an epoch ---------------

MONTH = "(year(l_shipdate) * 12 + month(l_shipdate))"
LOG = f"""(SELECT l_suppkey AS run, {MONTH} AS epoch, sum(l_quantity) AS elbo, count(*)::DOUBLE AS recon, max(l_quantity) AS kl,
 min(l_quantity) AS cat, max(l_extendedprice) AS num FROM lineitem GROUP BY ALL)"""
SERIES = ["elbo", "recon", "kl", "cat", "num"]


def train_log(spark, d):
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint")
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), month.alias("epoch")).agg(
        F.sum("l_quantity").alias("elbo"), F.count(F.lit(1)).cast("double").alias("recon"), F.max("l_quantity").alias("kl"),
        F.min("l_quantity").alias("cat"), F.max("l_extendedprice").alias("num"))


@query("train_log_long", " UNION ALL ".join(f"SELECT run, epoch, '{s}' AS series, {s} AS value FROM {LOG}" for s in SERIES))
def train_log_long(spark, d):
    return summary.long_form(train_log(spark, d), ["run", "epoch"], SERIES, "series")


@query("early_stop_epoch", f"""
WITH RECURSIVE x AS (SELECT run, elbo, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM {LOG}),
s AS (SELECT run, i, elbo AS best, 1 AS misses FROM x WHERE i = 1
      UNION ALL SELECT x.run, x.i, CASE WHEN x.elbo < s.best - 10 THEN x.elbo ELSE s.best END,
        CASE WHEN x.elbo < s.best - 10 THEN 0 ELSE s.misses + 1 END
      FROM s JOIN x ON x.run = s.run AND x.i = s.i + 1 WHERE s.misses < 5)
SELECT run, max(i)::INTEGER AS epochs, arg_max(misses, i) = 5 AS stopped FROM s GROUP BY run""")
def early_stop_epoch(spark, d):
    return summary.early_stop(train_log(spark, d), ["run"], "epoch", "elbo", patience=5, delta=10.0)
