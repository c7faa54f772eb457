"""Privacy accounting over ledgers derived from orders, and clipping of embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabloom.functions.order import linear_recurrence
from tabloom.privacy import accountant as A
from tabloom.privacy import clip as K
from tabloom.privacy import sampling as S
from tabloom.privacy.ledger import StoredLedger
from tabloom.sources.io import scratch

from .base import given_u, load, query, r, sql_r, sql_u
from .encoders import sql_ppf

DELTA = 1e-5
ORDERS = [*range(2, 64), 128, 256]
WHOLE = [int(a) for a in A.DEFAULT_ORDERS if a == int(a)]
FRACTIONS = [a for a in A.DEFAULT_ORDERS if a != int(a)]

# every customer is a dataset; each order status it has is one mechanism of its ledger
LEDGER = """(SELECT o_custkey AS dataset, 1 / (10 + o_custkey % 13)::DOUBLE AS q, 0.8 + (o_custkey % 5) * 0.4::DOUBLE AS sigma,
 o_orderstatus AS run, count(*) AS steps FROM orders GROUP BY ALL)"""


def ledger(spark, d):
    k = F.col("o_custkey")
    return load(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("steps")).select(
        k.alias("dataset"), (1 / (10 + F.pmod(k, F.lit(13))).cast("double")).alias("q"),
        (F.lit(0.8) + F.pmod(k, F.lit(5)) * 0.4).alias("sigma"), F.col("o_orderstatus").alias("run"), "steps")


def settings(spark, d):
    return ledger(spark, d).select("q", "sigma").distinct()


SETTINGS = f"(SELECT DISTINCT q, sigma FROM {LEDGER})"
LGAMMA = "lgamma(alpha + 1) - lgamma(i + 1) - lgamma(alpha - i + 1)"


def integer_sql(source: str, keys: str, orders=ORDERS) -> str:
    """rdp per step of (keys incl. q, sigma) at integer orders."""
    return f"""(SELECT {keys}, alpha::DOUBLE AS alpha, (any_value(m) + ln(sum(exp(t - m)))) / (alpha - 1) AS rdp_step
FROM (SELECT *, max(t) OVER (PARTITION BY {keys}, alpha) AS m FROM (
  SELECT {keys}, alpha, {LGAMMA} + i * ln(q) + (alpha - i) * ln(1 - q) + (i * i - i) / (2 * sigma * sigma) AS t
  FROM {source}, (SELECT unnest({list(orders)}) AS alpha), (SELECT unnest(range(0, {orders[-1] + 1})) AS i)
  WHERE i <= alpha)) GROUP BY {keys}, alpha)"""


def shown(df, *keys):
    return df.select(*[r(F.col(k), 9).alias(k) for k in keys], "alpha", r(F.col("rdp")).alias("rdp"))


Q9, S9 = f"{sql_r('q', 9)} AS q", f"{sql_r('sigma', 9)} AS sigma"


@query("rdp_integer", f"SELECT {Q9}, {S9}, alpha, {sql_r('rdp_step')} AS rdp FROM {integer_sql(SETTINGS, 'q, sigma')}")
def rdp_integer(spark, d):
    rows = A.with_orders(settings(spark, d), ORDERS)
    return shown(rows.withColumn("rdp", A.rdp_integer(F.col("q"), F.col("sigma"), F.col("alpha"), max(ORDERS))), "q", "sigma")


FRACTIONAL_SQL = f"""(SELECT q, sigma, alpha, ln(1 + sum(h / (sigma * sqrt(2 * pi())) * exp(-z * z / (2 * sigma * sigma))
   * (pow((1 - q) + q * exp((2 * z - 1) / (2 * sigma * sigma)), alpha) - 1))) / (alpha - 1) AS rdp_step
FROM (SELECT q, sigma, alpha, (alpha + 24 * sigma) / 4000 AS h, -12 * sigma + i * (alpha + 24 * sigma) / 4000 AS z
      FROM {SETTINGS}, (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in FRACTIONS)}]) AS alpha),
           (SELECT unnest(range(0, 4001)) AS i)) GROUP BY q, sigma, alpha)"""


@query("rdp_fractional", f"SELECT {Q9}, {S9}, alpha, {sql_r('rdp_step')} AS rdp FROM {FRACTIONAL_SQL}")
def rdp_fractional(spark, d):
    rows = A.with_orders(settings(spark, d), FRACTIONS).repartition(8, "q", "sigma", "alpha")
    return shown(rows.withColumn("rdp", A.rdp_fractional(F.col("q"), F.col("sigma"), F.col("alpha"))), "q", "sigma")


@query("rdp_special", """
SELECT c_custkey, q, sigma, alpha, CASE WHEN q = 0 THEN 0 WHEN sigma = 0 OR isinf(alpha) THEN 'Infinity'::DOUBLE
   ELSE alpha / (2 * sigma * sigma) END AS rdp
FROM (SELECT c_custkey, (c_custkey % 2)::DOUBLE AS q, (c_custkey % 3)::DOUBLE AS sigma,
             CASE WHEN c_custkey % 5 = 0 THEN 'Infinity'::DOUBLE ELSE 2 + c_custkey % 7 END AS alpha FROM customer)""")
def rdp_special(spark, d):
    k = F.col("c_custkey")
    rows = load(spark, d, "customer").select(
        k, F.pmod(k, F.lit(2)).cast("double").alias("q"), F.pmod(k, F.lit(3)).cast("double").alias("sigma"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(math.inf)).otherwise(2 + F.pmod(k, F.lit(7)).cast("double")).alias("alpha"))
    q, s, a = F.col("q"), F.col("sigma"), F.col("alpha")
    known = F.when((q == 0) | (q == 1) | (s == 0) | (a == F.lit(math.inf)), A.rdp_step(q, s, a, False))
    return rows.withColumn("rdp", known)


STEPS = f"""(SELECT q, sigma, alpha, rdp_step FROM {integer_sql(SETTINGS, 'q, sigma', WHOLE)}
 UNION ALL SELECT q, sigma, alpha, rdp_step FROM {FRACTIONAL_SQL})"""
CURVE = f"""(SELECT l.dataset, l.run, l.q, l.sigma, c.alpha, l.steps * c.rdp_step AS rdp
 FROM {LEDGER} l JOIN {STEPS} c ON l.q = c.q AND l.sigma = c.sigma)"""


@query("rdp_curve", f"SELECT dataset, run, alpha, {sql_r('rdp')} AS rdp FROM {CURVE}")
def rdp_curve(spark, d):
    out = A.rdp_curve(ledger(spark, d), A.DEFAULT_ORDERS)
    return out.select("dataset", "run", "alpha", r(F.col("rdp")).alias("rdp"))


@query("rdp_ledger", f"SELECT dataset, alpha, {sql_r('sum(rdp)')} AS rdp FROM {CURVE} GROUP BY dataset, alpha")
def rdp_ledger(spark, d):
    out = A.compose(ledger(spark, d), ["dataset"], A.DEFAULT_ORDERS)
    return out.withColumn("rdp", r(F.col("rdp")))


EPS = f"rdp - (ln({DELTA}::DOUBLE) + ln(alpha)) / (alpha - 1) + ln((alpha - 1) / alpha)"


@query("eps_spent", f"""
SELECT dataset, {sql_r('min(eps)')} AS epsilon, arg_min(alpha, eps) AS best_alpha
FROM (SELECT dataset, alpha, {EPS} AS eps FROM (SELECT dataset, alpha, sum(rdp) AS rdp FROM {CURVE} GROUP BY ALL)) GROUP BY dataset""")
def eps_spent(spark, d):
    curve = A.compose(ledger(spark, d), ["dataset"], A.DEFAULT_ORDERS)
    return A.privacy_spent(curve, ["dataset"], DELTA).withColumn("epsilon", r(F.col("epsilon")))


# two sessions extend one stored ledger, and one of them repeats a commit
@query("ledger_stored", f"""
SELECT x.dataset, {sql_r('epsilon')} AS epsilon, best_alpha, steps::BIGINT AS steps
FROM (SELECT dataset, min(eps) AS epsilon, arg_min(alpha, eps) AS best_alpha
      FROM (SELECT dataset, alpha, {EPS} AS eps FROM (SELECT dataset, alpha, sum(rdp) AS rdp FROM {CURVE} GROUP BY ALL)) GROUP BY dataset) x
JOIN (SELECT dataset, sum(steps) AS steps FROM {LEDGER} GROUP BY dataset) y USING (dataset)""")
def ledger_stored(spark, d):
    path = scratch(spark, "ledger")
    for s in (spark, spark.newSession()):
        rows = ledger(s, d)
        part = F.pmod(F.xxhash64("dataset", "q", "sigma"), F.lit(3))
        kept = StoredLedger(s, path)
        kept.commit("run-0", rows.where(part == 0))
        kept.commit("run-1", rows.where(part == 1))
    kept.commit("run-2", rows.where(part == 2))
    both = StoredLedger(spark, path)
    return both.spent(DELTA).join(both.steps(), "dataset").withColumn("epsilon", r(F.col("epsilon")))


RUNS = f"(SELECT DISTINCT q, sigma, steps AS epochs, (steps * ceil(1 / q))::BIGINT AS steps FROM {LEDGER})"


@query("dp_report", f"""
SELECT {Q9}, {S9}, epochs, steps, {sql_r('min(eps)')} AS epsilon, arg_min(alpha, eps) AS best_alpha,
       arg_min(alpha, eps) IN ({A.DEFAULT_ORDERS[0]}::DOUBLE, {A.DEFAULT_ORDERS[-1]}::DOUBLE) AS at_end
FROM (SELECT r.q, r.sigma, epochs, steps, alpha, {EPS.replace('rdp ', 'steps * rdp_step ')} AS eps
      FROM {RUNS} r JOIN {STEPS} c ON r.q = c.q AND r.sigma = c.sigma) GROUP BY q, sigma, epochs, steps""")
def dp_report(spark, d):
    runs = ledger(spark, d).withColumnRenamed("steps", "epochs")
    out = A.report(runs, A.DEFAULT_ORDERS, DELTA)
    return out.withColumns({"q": r(F.col("q"), 9), "sigma": r(F.col("sigma"), 9), "epsilon": r(F.col("epsilon"))})


TARGETS = """(SELECT DISTINCT CASE WHEN o_custkey % 11 = 0 THEN 0.000001::DOUBLE ELSE 2 + o_custkey % 3 * 1.5::DOUBLE END AS target, 1 / (20 + o_custkey % 2 * 30)::DOUBLE AS q, 2 AS epochs FROM orders)"""


def noise_sql() -> str:
    key = "target, q, epochs, steps"
    eps = EPS.replace("rdp ", "steps * rdp_step ")

    def feasible(grid: str) -> str:
        return f"""(SELECT {key}, min(sigma) AS sigma FROM (
 SELECT {key}, sigma, min({eps}) AS eps FROM {integer_sql(grid, key + ', sigma', A.INTEGER_ORDERS)} GROUP BY {key}, sigma)
 WHERE eps <= target GROUP BY {key})"""

    runs = f"(SELECT *, (epochs * ceil(1 / q))::BIGINT AS steps FROM {TARGETS})"
    coarse = f"(SELECT * FROM {runs}, (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in A.COARSE_SIGMAS)}]) AS sigma))"
    fine = f"""(SELECT {key}, least(high, low + w * j) AS sigma FROM (
 SELECT *, unnest(range(1, ceil((high - low) / w)::INTEGER + 1)) AS j FROM (
  SELECT {key}, sigma AS high, CASE WHEN sigma = 0.5 THEN 0 ELSE sigma / 2 END AS low, greatest(0.01::DOUBLE, sigma / 2000) AS w
  FROM top)))"""
    return f"""WITH top AS MATERIALIZED {feasible(coarse)}
SELECT target, {Q9}, epochs, steps, {sql_r('sigma')} AS sigma, sigma IS NOT NULL AS feasible
FROM {runs} LEFT JOIN {feasible(fine)} USING ({key})"""


@query("noise_for_eps", noise_sql())
def noise_for_eps(spark, d):
    k = F.col("o_custkey")
    wanted = load(spark, d, "orders").select(
        F.when(F.pmod(k, F.lit(11)) == 0, 0.000001).otherwise(2 + F.pmod(k, F.lit(3)) * 1.5).alias("target"),
        (1 / (20 + F.pmod(k, F.lit(2)) * 30).cast("double")).alias("q"), F.lit(2).alias("epochs")).distinct()
    out = A.noise_for_epsilon(wanted, DELTA)
    return out.withColumns({"q": r(F.col("q"), 9), "sigma": r(F.col("sigma"))})


# --- clipping ----------------------------------------------------------------

def squares(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE))"


def sql_norm(v: str) -> str:
    return f"sqrt({squares(v)})"


HALVES = ("embedding[1:32]", "embedding[33:64]")
C_FLAT, C_BLOCK = 0.9, (0.6, 0.75)


def vectors(spark, d):
    df = load(spark, d, "embeddings")
    return df.select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))


def block_norms(spark, d):
    items = F.array(F.struct(F.lit(0).alias("block"), K.norm(F.col("a")).alias("norm")),
                    F.struct(F.lit(1).alias("block"), K.norm(F.col("b")).alias("norm")))
    return vectors(spark, d).select("vec_id", F.explode(items).alias("x")).select("vec_id", "x.*")


BLOCK_NORMS = "(" + " UNION ALL ".join(
    f"SELECT vec_id, {i}::INTEGER AS block, {sql_norm(h)} AS norm, {c}::DOUBLE AS threshold FROM embeddings"
    for i, (h, c) in enumerate(zip(HALVES, C_BLOCK))) + ")"


def sql_factor(norm: str, c) -> str:
    return f"least(1.0::DOUBLE, {c}::DOUBLE / ({norm} + 1e-6::DOUBLE))"


@query("row_norm_flat", f"SELECT vec_id, {sql_r(sql_norm('embedding'))} AS norm FROM embeddings")
def row_norm_flat(spark, d):
    return vectors(spark, d).select("vec_id", r(K.flat_norm([F.col("a"), F.col("b")])).alias("norm"))


@query("row_norm_block", f"SELECT vec_id, block, {sql_r('norm')} AS norm FROM {BLOCK_NORMS}")
def row_norm_block(spark, d):
    return block_norms(spark, d).withColumn("norm", r(F.col("norm")))


@query("clip_flat", f"SELECT vec_id, {sql_r(sql_factor(sql_norm('embedding'), C_FLAT))} AS factor FROM embeddings")
def clip_flat(spark, d):
    n = K.flat_norm([F.col("a"), F.col("b")])
    return vectors(spark, d).select("vec_id", r(K.factor(n, C_FLAT)).alias("factor"))


@query("clip_block", f"SELECT vec_id, block, {sql_r(sql_factor('norm', 'threshold'))} AS factor FROM {BLOCK_NORMS}")
def clip_block(spark, d):
    c = K.thresholds_for(2, list(C_BLOCK))
    threshold = F.when(F.col("block") == 0, c[0]).otherwise(c[1])
    return block_norms(spark, d).select("vec_id", "block", r(K.factor(F.col("norm"), threshold)).alias("factor"))


def clipped_sql(per_block: bool) -> str:
    parts = []
    for i, h in enumerate(HALVES):
        f = sql_factor(sql_norm(h), C_BLOCK[i]) if per_block else sql_factor(sql_norm("embedding"), C_FLAT)
        parts.append(f"SELECT {i}::INTEGER AS block, vec_id, unnest(range(32)) AS pos, unnest({h})::DOUBLE * {f} AS x FROM embeddings")
    return f"({' UNION ALL '.join(parts)})"


def sum_sql(per_block: bool, mean: bool) -> str:
    value = "sum(x) / count(*)" if mean else "sum(x)"
    return f"SELECT block, pos::INTEGER AS pos, {sql_r(value)} AS value FROM {clipped_sql(per_block)} GROUP BY block, pos"


@query("clipped_sum", sum_sql(per_block=True, mean=False))
def clipped_sum(spark, d):
    out = K.clipped_sum(vectors(spark, d), ["a", "b"], list(C_BLOCK), per_block=True)
    return out.select("block", "pos", r(F.col("total")).alias("value"))


@query("clipped_mean", sum_sql(per_block=False, mean=True))
def clipped_mean(spark, d):
    out = K.clipped_sum(vectors(spark, d), ["a", "b"], [C_FLAT])
    return out.select("block", "pos", r(F.col("total") / F.col("n")).alias("value"))


NOISE = 1.3


@query("noisy_sum", f"""
SELECT block, pos, {sql_r(f"(total + {sql_ppf('u')} * {K.noise_scale(list(C_BLOCK), NOISE)!r}::DOUBLE) / n")} AS value
FROM (SELECT block, pos::INTEGER AS pos, sum(x) AS total, count(*) AS n, {sql_u('block * 1000 + pos', 8)} AS u FROM {clipped_sql(per_block=True)} GROUP BY ALL)""")
def noisy_sum(spark, d):
    out = K.noisy_mean(vectors(spark, d), ["a", "b"], list(C_BLOCK), sigma=NOISE, per_block=True,
                       u=given_u(F.col("block") * 1000 + F.col("pos"), 8))
    return out.withColumn("value", r(F.col("value")))


NORMS = f"(SELECT {sql_norm('embedding')} AS norm FROM embeddings)"


def norms(spark, d):
    return vectors(spark, d).select(K.flat_norm([F.col("a"), F.col("b")]).alias("norm"))


@query("thresh_pvalue", f"""
SELECT {sql_r('norm')} AS threshold FROM (SELECT norm, row_number() OVER (ORDER BY norm) AS k, count(*) OVER () AS n FROM {NORMS})
WHERE k = greatest(1, floor(n * 0.75::DOUBLE))""")
def thresh_pvalue(spark, d):
    value = K.threshold_rank(norms(spark, d), "norm", 0.25)
    return spark.createDataFrame([(float(value),)], "threshold double").withColumn("threshold", r(F.col("threshold")))


@query("thresh_mean", f"SELECT {sql_r('greatest(min(norm), avg(norm) + 0.5::DOUBLE * stddev_samp(norm) + 1e-8)')} AS threshold FROM {NORMS}")
def thresh_mean(spark, d):
    return K.threshold_mean(norms(spark, d), "norm", 0.5).withColumn("threshold", r(F.col("threshold")))


LINE_VALUES = "(SELECT l_extendedprice AS norm FROM lineitem)"


@query("thresh_otsu", f"""
WITH s AS (SELECT min(norm) AS lo, max(norm) AS hi, pow(2, floor(1 + log2(count(*)) / 2)) AS bins FROM {LINE_VALUES}),
h AS (SELECT least(bins - 1, floor((norm - lo) / ((hi - lo) / bins)))::INTEGER AS bin, count(*)::DOUBLE AS w,
             any_value(lo) + (bin + 0.5::DOUBLE) * ((any_value(hi) - any_value(lo)) / any_value(bins)) AS centre
      FROM {LINE_VALUES}, s GROUP BY bin),
c AS (SELECT bin, centre, sum(w) OVER a AS w1, sum(w * centre) OVER a AS m1, sum(w) OVER b AS w2, sum(w * centre) OVER b AS m2 FROM h
      WINDOW a AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), b AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT {sql_r('centre')} AS threshold, bin FROM c WHERE w2 IS NOT NULL ORDER BY w1 * w2 * (m1 / w1 - m2 / w2) ** 2 DESC, bin LIMIT 1""")
def thresh_otsu(spark, d):
    values = load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("norm"))
    return K.threshold_otsu(values, "norm").withColumn("threshold", r(F.col("threshold")))


# logarithms, so that no running value ends in a digit 5 where it is rounded
@query("thresh_momentum", f"""
WITH RECURSIVE x AS (SELECT user_id, event_id, ln(value + 1) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
t AS (SELECT user_id, event_id, i, 0.1::DOUBLE * value + 0.9::DOUBLE * 1.0 AS t FROM x WHERE i = 1
      UNION ALL SELECT x.user_id, x.event_id, x.i, 0.1::DOUBLE * x.value + 0.9::DOUBLE * t.t FROM t JOIN x ON x.user_id = t.user_id AND x.i = t.i + 1)
SELECT user_id, event_id, {sql_r("t")} AS threshold FROM t""")
def thresh_momentum(spark, d):
    df = load(spark, d, "events").select("user_id", "event_id", F.ln(F.col("value") + 1).alias("value"))
    out = linear_recurrence(df, ["user_id"], ["event_id"], "value", 0.9, 1.0, "threshold")
    return out.select("user_id", "event_id", r(F.col("threshold")).alias("threshold"))


POISSON_RATE = 0.05
POISSON_TOP = S.batches_per_epoch(POISSON_RATE)


# the subset grows by one number a step: the drawn one, or the step's own if that is taken
@query("poisson_batches", f"""
WITH RECURSIVE n AS (SELECT o_orderkey, o_totalprice, len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in S.binomial_cdf(POISSON_TOP, POISSON_RATE))}],
  lambda c: c <= {sql_u('o_orderkey * 31', 3)})) AS n FROM orders),
t AS (SELECT o_orderkey, o_totalprice, {POISSON_TOP} - n + 1 AS step, []::BIGINT[] AS taken FROM n WHERE n > 0
  UNION ALL SELECT o_orderkey, o_totalprice, step + 1, list_append(taken, CASE WHEN list_contains(taken, drawn) THEN step ELSE drawn END)
  FROM (SELECT *, least(step, floor({sql_u('o_orderkey * 31 + step * 17', 3)} * step)::BIGINT + 1) AS drawn FROM t WHERE step <= {POISSON_TOP}))
SELECT o_orderkey, o_totalprice, unnest(taken)::INTEGER AS batch FROM t WHERE step > {POISSON_TOP}""")
def poisson_batches(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.poisson_batches(df, ["o_orderkey"], S.sample_rate(rate=POISSON_RATE),
                             u=lambda step: given_u(F.col("o_orderkey") * 31 + step * 17, 3))


@query("poisson_empty", f"SELECT o_orderkey, floor(ln({sql_u('o_orderkey', 6)}) / {10 * math.log(0.9)!r}::DOUBLE)::BIGINT AS empty_batches FROM orders")
def poisson_empty(spark, d):
    return load(spark, d, "orders").select("o_orderkey", S.empty_batches(given_u("o_orderkey", 6), 10, 0.1).alias("empty_batches"))


@query("clip_report", f"""
SELECT block, threshold, {', '.join(f"{sql_r(f'max(norm) FILTER (WHERE k = greatest(1, ceil({q}::DOUBLE * n)))')} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))},
 {sql_r('avg(least(1.0::DOUBLE, threshold / (norm + 1e-6::DOUBLE)))')} AS mean_factor, {sql_r('avg((norm > threshold)::INTEGER)')} AS share_clipped
FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY norm) AS k, count(*) OVER (PARTITION BY block) AS n FROM {BLOCK_NORMS})
GROUP BY block, threshold""")
def clip_report(spark, d):
    out = K.clip_report(block_norms(spark, d), dict(enumerate(C_BLOCK)))
    return out.withColumns({c: r(F.col(c)) for c in ("q25", "q50", "q75", "mean_factor", "share_clipped")})
