"""Renyi accounting of the sampled Gaussian mechanism as column expressions.

A mechanism is a row (q, sigma, steps). Curves are computed once per distinct
(q, sigma) and joined back, so the cost follows the number of settings while
composition follows the ledger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import let, literal_array
from tabloom.operators.joins import lookup_join

# The default orders.
DEFAULT_ORDERS = [1 + x / 10 for x in range(1, 100)] + [float(a) for a in range(12, 64)]
INTEGER_ORDERS = list(range(2, 64))
COARSE_SIGMAS = [0.5 * 2**k for k in range(13)]
FINE_STEP = 0.01


def log_factorials(top: int) -> list[float]:
    out = [0.0]
    for i in range(1, top + 1):
        out.append(out[-1] + math.log(i))
    return out


def log_sum_exp(terms: Column) -> Column:
    return let(terms, lambda t: let(F.array_max(t), lambda m: m + F.ln(
        F.aggregate(F.transform(t, lambda e: F.exp(e - m)), F.lit(0.0), lambda a, b: a + b))))


def rdp_integer(q: Column, sigma: Column, alpha: Column, top: int = 64) -> Column:
    """RDP of one step at an integer order up to ``top``, by the binomial expansion in log space; a higher order is an error."""
    lf = literal_array(log_factorials(top), "double")
    a = alpha.cast("int")

    def term(i: Column) -> Column:
        choose = F.get(lf, a) - F.get(lf, i) - F.get(lf, a - i)
        return choose + i * F.ln(q) + (a - i) * F.ln(1 - q) + (i * i - i) / (2 * sigma * sigma)

    value = log_sum_exp(F.transform(F.sequence(F.lit(0), a), term)) / (alpha - 1)
    return F.when(alpha > top, F.raise_error(F.lit(f"an order is above {top}; give a higher top")).cast("double")).otherwise(value)


def rdp_fractional(q: Column, sigma: Column, alpha: Column) -> Column:
    """RDP of one step at any order above 1, by quadrature (Mironov et al. 2019, 3.3).

    Integrates ((1-q) + q e^((2z-1)/(2 s^2)))^alpha against N(0, s^2), minus
    one, with the largest exponent taken out so that nothing overflows. The
    nearest singularity is pi s^2 off the real line, so equal steps of s^2 / 3
    err by e^-59; s / 8 does as much for the Gaussian.
    """
    var = sigma * sigma
    low, high = -12 * sigma, alpha + 12 * sigma
    count = F.ceil((high - low) / F.least(sigma / 8, var / 3)).cast("int")
    step = (high - low) / count
    shift = F.greatest(F.lit(0.0), alpha * F.ln(q) + (alpha * alpha - alpha) / (2 * var))

    def add(total: Column, i: Column) -> Column:
        def at(z: Column) -> Column:
            t = (2 * z - 1) / (2 * var)
            grow = alpha * F.when(t > 30, F.ln(q) + t + F.log1p((1 - q) / q * F.exp(-t))).otherwise(
                F.log1p(q * F.expm1(F.least(t, F.lit(30.0)))))
            weight = -z * z / (2 * var) - shift
            return F.when(grow < 1, F.exp(weight) * F.expm1(F.least(grow, F.lit(1.0)))).otherwise(
                F.exp(weight + grow) - F.exp(weight))
        return total + let(low + i * step, at)

    sums = F.aggregate(F.sequence(F.lit(0), count), F.lit(0.0), add)
    mass = sums * step / (sigma * math.sqrt(2 * math.pi))
    log_a = F.when(shift == 0, F.log1p(mass)).otherwise(shift + F.ln(F.exp(-shift) + mass))
    return log_a / (alpha - 1)


def rdp_step(q: Column, sigma: Column, alpha: Column, fractional: bool = True, top: int = 64) -> Column:
    """RDP of one step with the special cases; ``top`` is the largest integer order that occurs."""
    inf = F.lit(math.inf)
    general = rdp_integer(q, sigma, alpha, top)
    if fractional:
        general = F.when(alpha == F.floor(alpha), general).otherwise(rdp_fractional(q, sigma, alpha))
    return (F.when(q == 0, F.lit(0.0)).when(sigma == 0, inf).when(alpha == inf, inf)
            .when(q == 1, alpha / (2 * sigma * sigma)).otherwise(general))


def steps(epochs: Column, q: Column) -> Column:
    """Steps of a run: every epoch draws ceil(1/q) Poisson batches."""
    return (epochs * F.ceil(1 / q)).cast("bigint")


def with_orders(df: DataFrame, orders: list[float]) -> DataFrame:
    """One row per order, by expansion of the row (no join)."""
    return df.withColumn("alpha", F.explode(literal_array([float(a) for a in orders], "double")))


def largest(orders: list[float]) -> int:
    """The largest finite order, which sizes the table of factorials."""
    return max([64, *(math.ceil(a) for a in orders if math.isfinite(a))])


def rdp_curve(mechanisms: DataFrame, orders: list[float], fractional: bool = True) -> DataFrame:
    """Rows of ``mechanisms`` (q, sigma, steps, ...) times orders, with total rdp.

    One curve per distinct setting; attached through a size-checked lookup.
    """
    settings = mechanisms.select("q", "sigma").distinct()
    # few rows, but a quadrature or a series each
    tasks = int(mechanisms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    curves = with_orders(settings, orders).repartition(tasks, "q", "sigma", "alpha").withColumn(
        "rdp_step", rdp_step(F.col("q"), F.col("sigma"), F.col("alpha"), fractional, largest(orders)))
    packed = curves.groupBy("q", "sigma").agg(F.collect_list(F.struct("alpha", "rdp_step")).alias("curve"))
    joined = lookup_join(mechanisms, packed, ["q", "sigma"])
    return joined.withColumn("c", F.explode("curve")).select(
        *mechanisms.columns, F.col("c.alpha").alias("alpha"), (F.col("c.rdp_step") * F.col("steps")).alias("rdp"))


def compose(ledger: DataFrame, key: list[str], orders: list[float], fractional: bool = True) -> DataFrame:
    """(key, alpha, rdp): mechanisms of one dataset add up per order.

    Steps of equal settings are summed before curves are attached.
    """
    merged = ledger.groupBy(*key, "q", "sigma").agg(F.sum("steps").alias("steps"))
    return rdp_curve(merged, orders, fractional).groupBy(*key, "alpha").agg(F.sum("rdp").alias("rdp"))


def epsilon_at(rdp: Column, alpha: Column, delta: float) -> Column:
    return rdp - (math.log(delta) + F.ln(alpha)) / (alpha - 1) + F.ln((alpha - 1) / alpha)


def privacy_spent(curve: DataFrame, key: list[str], delta: float) -> DataFrame:
    """(key, epsilon, best_alpha): the smallest epsilon over the orders, NaN ignored; a null RDP is an error."""
    rdp = F.coalesce(F.col("rdp"), F.raise_error(F.lit("an order has no RDP")).cast("double"))
    eps = curve.withColumn("epsilon", epsilon_at(rdp, F.col("alpha"), delta))
    return (eps.where(~F.isnan("epsilon")).groupBy(*key)
            .agg(F.min(F.struct("epsilon", "alpha")).alias("best"))
            .select(*key, F.col("best.epsilon").alias("epsilon"), F.col("best.alpha").alias("best_alpha")))


def report(settings: DataFrame, orders: list[float], delta: float, fractional: bool = True) -> DataFrame:
    """Steps, epsilon and best order of distinct (q, sigma, epochs); flags an order at an end."""
    runs = settings.select("q", "sigma", "epochs").distinct().withColumn("steps", steps(F.col("epochs"), F.col("q")))
    key = ["q", "sigma", "epochs", "steps"]
    spent = privacy_spent(rdp_curve(runs, orders, fractional), key, delta)
    return spent.withColumn("at_end", F.col("best_alpha").isin(float(min(orders)), float(max(orders))))


def _feasible(grid: DataFrame, key: list[str], orders: list[int], delta: float) -> DataFrame:
    """Smallest sigma on each key's grid whose epsilon meets the target."""
    rows = with_orders(grid, [float(a) for a in orders])
    eps = epsilon_at(F.col("steps") * rdp_step(F.col("q"), F.col("sigma"), F.col("alpha"), False, largest(orders)), F.col("alpha"), delta)
    each = rows.groupBy(*key, "sigma").agg(F.min(eps).alias("epsilon"))
    return each.where(F.col("epsilon") <= F.col("target")).groupBy(*key).agg(F.min("sigma").alias("sigma"))


def noise_for_epsilon(settings: DataFrame, delta: float, orders: list[int] = INTEGER_ORDERS) -> DataFrame:
    """Smallest noise multiplier meeting each (target, q, epochs), as two grid passes.

    A doubling grid finds the bracket, a fine grid inside it the answer; the
    result meets the target. Where no grid value does, the row stays with a null
    sigma and ``feasible`` false.
    """
    key = ["target", "q", "epochs", "steps"]
    runs = settings.select("target", "q", "epochs").distinct().withColumn("steps", steps(F.col("epochs"), F.col("q")))
    coarse = runs.withColumn("sigma", F.explode(literal_array(COARSE_SIGMAS, "double")))
    top = _feasible(coarse, key, orders, delta).withColumnRenamed("sigma", "high")
    low = F.when(F.col("high") == COARSE_SIGMAS[0], F.lit(0.0)).otherwise(F.col("high") / 2)
    width = F.greatest(F.lit(FINE_STEP), F.col("high") / 2000)
    points = F.ceil((F.col("high") - low) / width).cast("int")
    fine = top.withColumns({"_low": low, "_w": width, "_n": points}).withColumn(
        "j", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    fine = fine.withColumn("sigma", F.least(F.col("high"), F.col("_low") + F.col("_w") * F.col("j"))).select(*key, "sigma")
    found = _feasible(fine, key, orders, delta)
    return runs.select(*key).join(found, key, "left").withColumn("feasible", F.col("sigma").isNotNull())
