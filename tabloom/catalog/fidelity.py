"""Fidelity and privacy metrics of a real and a synthetic version of lineitem."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tabloom.fidelity import distance, learned, marginal, pairwise
from tabloom.fidelity.row import metric_row
from tabloom.roles import ColumnRoles

from .base import load, query, r, sql_r

NUM = ["quantity", "price", "discount", "tax"]
CAT = ["flag", "status", "line"]
ROLES = ColumnRoles(categorical=tuple(CAT), continuous=tuple(NUM))

# the real table, and a synthetic one of the same shape: other marginals, one new category
REAL = """(SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
 l_returnflag AS flag, l_linestatus AS status, l_linenumber::VARCHAR AS line FROM lineitem)"""
SYNTH = """(SELECT (1 + (l_partkey * 7 + l_linenumber) % 50)::DOUBLE AS quantity,
 l_extendedprice + l_linenumber * 100::DOUBLE AS price, ((l_suppkey * 3 + l_linenumber) % 12)::DOUBLE / 100 AS discount,
 (l_orderkey % 9)::DOUBLE / 100 AS tax,
 CASE WHEN l_partkey % 4 = 0 THEN 'A' WHEN l_partkey % 4 = 2 THEN 'R' ELSE 'N' END AS flag,
 CASE WHEN l_suppkey % 3 = 0 THEN 'F' ELSE 'O' END AS status, ((l_partkey + l_linenumber) % 8 + 1)::VARCHAR AS line FROM lineitem)"""


def pair(spark, d):
    df = load(spark, d, "lineitem")
    c = F.col
    real = df.select(c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price"), c("l_discount").alias("discount"),
                     c("l_tax").alias("tax"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"),
                     c("l_linenumber").cast("string").alias("line"))
    part4 = F.pmod("l_partkey", F.lit(4))
    synth = df.select(
        (F.pmod(c("l_partkey") * 7 + c("l_linenumber"), F.lit(50)) + 1).cast("double").alias("quantity"),
        (c("l_extendedprice") + c("l_linenumber") * 100.0).alias("price"),
        (F.pmod(c("l_suppkey") * 3 + c("l_linenumber"), F.lit(12)).cast("double") / 100).alias("discount"),
        (F.pmod("l_orderkey", F.lit(9)).cast("double") / 100).alias("tax"),
        F.when(part4 == 0, "A").when(part4 == 2, "R").otherwise("N").alias("flag"),
        F.when(F.pmod("l_suppkey", F.lit(3)) == 0, "F").otherwise("O").alias("status"),
        (F.pmod(c("l_partkey") + c("l_linenumber"), F.lit(8)) + 1).cast("string").alias("line"))
    return real, synth


def union_sql(parts) -> str:
    return " UNION ALL ".join(parts)


def counts_sql(c: str, value: str | None = None, real: str = REAL, synth: str = SYNTH) -> str:
    """(value, r, s) of a column over both tables."""
    v = value or c
    return f"(SELECT v, sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s FROM (SELECT {v} AS v, 1 AS r, 0 AS s FROM {real} UNION ALL SELECT {v}, 0, 1 FROM {synth}) GROUP BY v)"


@query("chisq_stat", union_sql(f"""
SELECT '{c}' AS column_name, {sql_r('sum((s - e) * (s - e) / e)', 4)} AS statistic, count(*) - 1 AS dof
FROM (SELECT s, sum(s) OVER () * (r + 0.5::DOUBLE) / (sum(r) OVER () + count(*) OVER () / 2::DOUBLE) AS e FROM {counts_sql(c)})""" for c in CAT))
def chisq_stat(spark, d):
    out = marginal.chi_square(*pair(spark, d), CAT)
    return out.select(F.col("column").alias("column_name"), r(F.col("statistic"), 4).alias("statistic"), "dof")


def ks_sql(c: str, counts: str) -> str:
    return f"""SELECT '{c}' AS column_name, {sql_r('max(abs(f - g))')} AS distance, {sql_r('1 - max(abs(f - g))')} AS score
FROM (SELECT sum(r) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(r) OVER () AS f,
             sum(s) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS g FROM {counts})"""


def encoded_counts_sql(c: str) -> str:
    """Counts over the frequency-interval midpoints learnt on the real table; values that it lacks lie past them."""
    i = f"""(SELECT {c} AS value, (2 * sum(count(*)) OVER (ORDER BY count(*) DESC, {c} ROWS UNBOUNDED PRECEDING) - count(*))::DOUBLE
      / (2 * sum(count(*)) OVER ()) AS mid FROM {REAL} GROUP BY {c})"""
    return f"(SELECT coalesce(mid, 2) AS v, sum(r) AS r, sum(s) AS s FROM {counts_sql(c)} k LEFT JOIN {i} i ON k.v = i.value GROUP BY 1)"


def rounded_ks(out):
    return out.select(F.col("column").alias("column_name"), r(F.col("distance")).alias("distance"), r(F.col("score")).alias("score"))


KS_SQL = {c: ks_sql(c, counts_sql(c)) for c in NUM}
KSX_SQL = {**KS_SQL, **{c: ks_sql(c, encoded_counts_sql(c)) for c in CAT}}


@query("ks_stat", union_sql(KS_SQL.values()))
def ks_stat(spark, d):
    return rounded_ks(marginal.ks(*pair(spark, d), NUM))


@query("ks_extended", union_sql(KSX_SQL.values()))
def ks_extended(spark, d):
    return rounded_ks(marginal.ks_extended(*pair(spark, d), [*NUM, *CAT]))


def grid_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(9, greatest(0, floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10)))::INTEGER END"


def kl_continuous_sql(a: str, b: str, real: str = REAL, synth: str = SYNTH) -> str:
    limits = "(SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUM) + f" FROM {real})"
    cells = " UNION ALL ".join(
        f"SELECT ({grid_sql(a)}) * 10 + ({grid_sql(b)}) AS cell, {rs} FROM {t}, {limits}"
        for t, rs in ((real, "1 AS r, 0 AS s"), (synth, "0 AS r, 1 AS s")))
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, sum(p * ln(p / q)) AS kl
FROM (SELECT (r + 1e-5::DOUBLE) / sum(r + 1e-5::DOUBLE) OVER () AS p, (s + 1e-5::DOUBLE) / sum(s + 1e-5::DOUBLE) OVER () AS q
      FROM (SELECT g.cell, coalesce(sum(r), 0)::DOUBLE AS r, coalesce(sum(s), 0)::DOUBLE AS s
            FROM (SELECT unnest(range(100)) AS cell) g LEFT JOIN ({cells}) x ON x.cell = g.cell GROUP BY g.cell))"""


def kl_discrete_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, sum(p * ln(p / q)) AS kl
FROM (SELECT (r + 1e-5::DOUBLE) / sum(r + 1e-5::DOUBLE) OVER () AS p, (s + 1e-5::DOUBLE) / sum(s + 1e-5::DOUBLE) OVER () AS q
      FROM {counts_sql('pair', f"{a} || '/' || {b}")})"""


KLC_SQL = union_sql(kl_continuous_sql(a, b) for a, b in combinations(NUM, 2))
KLD_SQL = union_sql(kl_discrete_sql(a, b) for a, b in combinations(CAT, 2))


def kl_rounded_sql(inner: str) -> str:
    return f"SELECT column_a, column_b, {sql_r('kl')} AS kl, {sql_r('1 / (1 + kl)')} AS score FROM ({inner})"


def rounded_kl(out):
    return out.withColumns({"kl": r(F.col("kl")), "score": r(F.col("score"))})


@query("kl_continuous", kl_rounded_sql(KLC_SQL))
def kl_continuous(spark, d):
    return rounded_kl(pairwise.kl_continuous(*pair(spark, d), NUM))


@query("kl_discrete", kl_rounded_sql(KLD_SQL))
def kl_discrete(spark, d):
    return rounded_kl(pairwise.kl_discrete(*pair(spark, d), CAT))


@query("gm_loglik")
def gm_loglik(spark, d):
    return learned.mixture_log_likelihood(*pair(spark, d), NUM)


# a mixture of two given components over two columns
GIVEN = [(0.3, (20.0, 0.04), ((90.0, 0.02), (0.02, 0.0009))), (0.7, (30.0, 0.06), ((150.0, -0.05), (-0.05, 0.0012)))]


def density_sql(weight, mean, cov) -> str:
    (a, b), (_, c) = cov
    det = a * c - b * b
    dx, dy = f"(quantity - {mean[0]}::DOUBLE)", f"(discount - {mean[1]}::DOUBLE)"
    square = f"({c / det!r}::DOUBLE * {dx} * {dx} - {2 * b / det!r}::DOUBLE * {dx} * {dy} + {a / det!r}::DOUBLE * {dy} * {dy})"
    return f"{weight}::DOUBLE / (2 * pi() * sqrt({det!r}::DOUBLE)) * exp(-0.5::DOUBLE * {square})"


@query("gm_score_given", f"SELECT {sql_r('avg(ln(' + ' + '.join(density_sql(*g) for g in GIVEN) + '))', 4)} AS log_likelihood FROM {SYNTH}")
def gm_score_given(spark, d):
    rows = pair(spark, d)[1].select(F.array("quantity", "discount").alias("x"))
    found = learned.mean_log_density(rows, [w for w, _, _ in GIVEN], [(np.array(m), np.array(c)) for _, m, c in GIVEN])
    return found.select(r(F.col("log_likelihood"), 4).alias("log_likelihood"))


@query("svc_detection")
def svc_detection(spark, d):
    return learned.detection(*pair(spark, d), [*NUM, *CAT])


def gower_numeric_sql(c: str, counts: str | None = None) -> str:
    return f"""SELECT sum(coalesce(step, 0) * (f * (1 - g) + g * (1 - f)) / span) AS distance
FROM (SELECT lead(v) OVER (ORDER BY v) - v AS step, max(v) OVER () - min(v) OVER () AS span,
   sum(r) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(r) OVER () AS f,
   sum(s) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(s) OVER () AS g FROM {counts or counts_sql(c)})"""


def gower_category_sql(c: str) -> str:
    return f"SELECT 1 - sum(p * q) AS distance FROM (SELECT r / sum(r) OVER () AS p, s / sum(s) OVER () AS q FROM {counts_sql(c)})"


GOWER_SQL = union_sql([*(gower_numeric_sql(c) for c in NUM), *(gower_category_sql(c) for c in CAT)])


@query("gower_mean", f"SELECT {sql_r('avg(distance)')} AS gower FROM ({GOWER_SQL})")
def gower_mean(spark, d):
    return distance.gower_mean(*pair(spark, d), NUM, CAT).select(r(F.col("gower")).alias("gower"))


def corr_sql(table: str) -> str:
    return union_sql(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS corr FROM {table}" for a in NUM for b in NUM)


@query("corr_matrix", f"SELECT column_a, column_b, {sql_r('corr')} AS corr FROM ({corr_sql(REAL)})")
def corr_matrix(spark, d):
    return pairwise.correlation(pair(spark, d)[0], NUM).withColumn("corr", r(F.col("corr")))


DIFF_SQL = (f"(SELECT a.column_a, a.column_b, a.corr AS real, b.corr AS synthetic FROM ({corr_sql(REAL)}) a "
            f"JOIN ({corr_sql(SYNTH)}) b USING (column_a, column_b))")


@query("corr_diff", f"SELECT column_a, column_b, {sql_r('real')} AS real, {sql_r('synthetic')} AS synthetic, {sql_r('real - synthetic')} AS difference FROM {DIFF_SQL}")
def corr_diff(spark, d):
    out = pairwise.correlation_difference(*pair(spark, d), NUM)
    return out.withColumns({c: r(F.col(c)) for c in ("real", "synthetic", "difference")})


@query("corr_rmse", f"SELECT {sql_r('sqrt(avg((real - synthetic) * (real - synthetic)))')} AS rmse FROM {DIFF_SQL}")
def corr_rmse(spark, d):
    return pairwise.correlation_rmse(*pair(spark, d), NUM).select(r(F.col("rmse")).alias("rmse"))


@query("hist_compare_num", union_sql(f"""
SELECT '{c}' AS column_name, '{name}' AS source, least(10, floor(({c} - lo) / (hi - lo) * 10) + 1)::INTEGER AS bin, count(*) AS n
FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}) GROUP BY bin""" for c in NUM for name, t in (("real", REAL), ("synthetic", SYNTH))))
def hist_compare_num(spark, d):
    return marginal.histogram_numeric(*pair(spark, d), NUM).withColumnRenamed("column", "column_name")


# --- missing numbers written as NaN ---------------------------------------------

HOLES = {"quantity": "3", "tax": "5"}


def with_nan(spark, d):
    """The same tables with NaN in two columns; the SQL has nulls there."""
    return [t.withColumns({c: F.when(F.col("line") == v, F.lit(float("nan"))).otherwise(F.col(c)) for c, v in HOLES.items()})
            for t in pair(spark, d)]


REAL_GAPS, SYNTH_GAPS = ("(SELECT * REPLACE (" + ", ".join(f"CASE WHEN line = '{v}' THEN NULL ELSE {c} END AS {c}" for c, v in HOLES.items())
                         + f") FROM {t})" for t in (REAL, SYNTH))


def gap_counts(c: str) -> str:
    return f"(SELECT * FROM {counts_sql(c, None, REAL_GAPS, SYNTH_GAPS)} WHERE v IS NOT NULL)"


@query("ks_nan", union_sql(ks_sql(c, gap_counts(c)) for c in NUM))
def ks_nan(spark, d):
    return rounded_ks(marginal.ks(*with_nan(spark, d), NUM))


@query("kl_nan", kl_rounded_sql(union_sql(kl_continuous_sql(a, b, REAL_GAPS, SYNTH_GAPS) for a, b in combinations(NUM, 2))))
def kl_nan(spark, d):
    return rounded_kl(pairwise.kl_continuous(*with_nan(spark, d), NUM))


@query("gower_nan", f"SELECT {sql_r('avg(distance)')} AS gower FROM ({union_sql(gower_numeric_sql(c, gap_counts(c)) for c in NUM)})")
def gower_nan(spark, d):
    return distance.gower_mean(*with_nan(spark, d), NUM, []).select(r(F.col("gower")).alias("gower"))


@query("corr_nan", f"SELECT column_a, column_b, {sql_r('corr')} AS corr FROM ({corr_sql(REAL_GAPS)})")
def corr_nan(spark, d):
    return pairwise.correlation(with_nan(spark, d)[0], NUM).withColumn("corr", r(F.col("corr")))


@query("hist_nan", union_sql(f"""
SELECT '{c}' AS column_name, '{name}' AS source, least(10, floor(({c} - lo) / (hi - lo) * 10) + 1)::INTEGER AS bin, count(*) AS n
FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}) WHERE {c} IS NOT NULL GROUP BY bin"""
    for c in NUM for name, t in (("real", REAL_GAPS), ("synthetic", SYNTH_GAPS))))
def hist_nan(spark, d):
    return marginal.histogram_numeric(*with_nan(spark, d), NUM).withColumnRenamed("column", "column_name")


@query("hist_compare_cat", union_sql(
    f"SELECT '{c}' AS column_name, v AS value, r::BIGINT AS real, s::BIGINT AS synthetic FROM {counts_sql(c)}" for c in CAT))
def hist_compare_cat(spark, d):
    return marginal.histogram_categories(*pair(spark, d), CAT).withColumnRenamed("column", "column_name")


@query("attack_numeric")
def attack_numeric(spark, d):
    return learned.attack(*pair(spark, d), ROLES, "price")


@query("attack_categorical")
def attack_categorical(spark, d):
    return learned.attack(*pair(spark, d), ROLES, "flag")


ROW_SQL = {
    "KSTest": f"SELECT avg(score) FROM ({union_sql(KS_SQL.values())})",
    "KSTestExtended": f"SELECT avg(score) FROM ({union_sql(KSX_SQL.values())})",
    "ContinuousKLDivergence": f"SELECT avg(1 / (1 + kl)) FROM ({KLC_SQL})",
    "DiscreteKLDivergence": f"SELECT avg(1 / (1 + kl)) FROM ({KLD_SQL})",
    "Gower": f"SELECT avg(distance) FROM ({GOWER_SQL})",
}


@query("metric_row", "SELECT " + ", ".join(f"{sql_r(f'({s})', 4)} AS {n}" for n, s in ROW_SQL.items()))
def metric_row_query(spark, d):
    names = [n for n in ROW_SQL if n != "Gower"]
    out = metric_row(*pair(spark, d), ROLES, names, gower=True)
    return out.select(*[r(F.col(n), 4).alias(n) for n in out.columns])
