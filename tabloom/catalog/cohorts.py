"""The three cohort jobs over the stand-in clinical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import dates
from tabloom.plans.cohort import CohortTables, Draws, build_cohort

from .base import given_u, load, query
from .relational import AGE_SQL, REBASE_SQL, REF, birth, shift_sql

# one bigint per chart row, in row order: order, line number, then a mix of part and supplier
CHART_KEY_SQL = "((l_orderkey * 8 + l_linenumber) * 4194304 + (l_partkey * 199 + l_suppkey) % 4194304)"
ROW_KEY_SQL = "(admission_key * 31 + ICUSTAY_ID * 17 + chart_key % 1000003)"


def tables(spark, d) -> CohortTables:
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem")
    admissions = orders.select(
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("admission_key"),
        F.col("o_orderstatus").alias("ETHNICITY"), F.col("o_orderdate").alias("ADMITTIME"),
        dates.add_days(F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(30)) + 1).alias("DISCHTIME"),
        F.col("o_orderpriority").alias("DISCHARGE_LOCATION"))
    patients = load(spark, d, "customer").select(
        F.col("c_custkey").alias("SUBJECT_ID"), F.col("c_mktsegment").alias("GENDER"), birth().alias("DOB"))
    stays = orders.select(F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("ICUSTAY_ID"),
                          F.col("o_orderpriority").alias("FIRST_CAREUNIT"))
    owner = orders.select(F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderkey").alias("ICUSTAY_ID"))
    key = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4194304
           + F.pmod(F.col("l_partkey") * 199 + F.col("l_suppkey"), F.lit(4194304)))
    charts = lines.select(
        F.col("l_orderkey").alias("ICUSTAY_ID"), F.col("l_shipdate").alias("CHARTTIME"),
        F.col("l_partkey").alias("ITEMID"), F.col("l_quantity").alias("VALUE"),
        F.col("l_returnflag").alias("VALUEUOM"), key.alias("chart_key")).join(owner, "ICUSTAY_ID")
    items = load(spark, d, "part").select(F.col("p_partkey").alias("ITEMID"), F.col("p_type").alias("LABEL"))
    return CohortTables(admissions, patients, stays, charts, items)


def draws() -> Draws:
    row = F.col("admission_key") * 31 + F.col("ICUSTAY_ID") * 17 + F.pmod("chart_key", F.lit(1000003))
    return Draws(given_u("SUBJECT_ID", 1), given_u(row, 2), given_u(row, 3), given_u(row, 4))


def cohort_sql(cap_rule: str, head: int | None) -> str:
    source = f"""
SELECT a.o_custkey AS SUBJECT_ID, a.o_orderkey AS admission_key, a.o_orderstatus AS ETHNICITY,
  a.o_orderdate AS admit, a.o_orderdate + to_days((a.o_orderkey % 30 + 1)::INTEGER) AS discharge,
  a.o_orderpriority AS DISCHARGE_LOCATION, c_mktsegment AS GENDER, dob, dob_offset,
  s.o_orderkey AS ICUSTAY_ID, s.o_orderpriority AS FIRST_CAREUNIT, ITEMID, VALUE, VALUEUOM, chart_key
FROM orders a JOIN ({REBASE_SQL}) p ON a.o_custkey = p.c_custkey
JOIN (SELECT c_custkey AS ck, c_mktsegment FROM customer) m ON m.ck = a.o_custkey
JOIN orders s ON s.o_custkey = a.o_custkey
JOIN capped ON capped.SUBJECT_ID = s.o_custkey AND capped.stay = s.o_orderkey"""
    head_sql = "" if head is None else (
        f"QUALIFY row_number() OVER (PARTITION BY SUBJECT_ID ORDER BY admission_key, ICUSTAY_ID, chart_key) <= {head}")
    return f"""
WITH charts AS (
  SELECT o_custkey AS SUBJECT_ID, l_orderkey AS stay, l_partkey AS ITEMID, l_quantity AS VALUE,
         l_returnflag AS VALUEUOM, {CHART_KEY_SQL} AS chart_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
{cap_rule},
moved AS ({shift_sql(source, ROW_KEY_SQL)})
SELECT SUBJECT_ID, ETHNICITY, new_admit AS ADMITTIME, new_discharge AS DISCHTIME, DISCHARGE_LOCATION, GENDER,
  dob AS DOB, dob_offset AS DOB_offset, FIRST_CAREUNIT, new_chart AS CHARTTIME, VALUE, VALUEUOM, p_type AS LABEL,
  {AGE_SQL.format(ref=REF, dob='dob')} AS age
FROM moved JOIN part ON ITEMID = p_partkey
WHERE new_admit < new_chart AND new_discharge > new_chart
{head_sql}"""


FIRST_PER_STAY = """capped AS (
  SELECT * FROM charts QUALIFY row_number() OVER (PARTITION BY SUBJECT_ID, stay ORDER BY chart_key) = 1)"""


def tier_rule(low: float, high: float) -> str:
    return f"""
firsts AS (SELECT SUBJECT_ID, min(chart_key) AS f FROM charts GROUP BY SUBJECT_ID),
ranked AS (SELECT SUBJECT_ID, row_number() OVER (ORDER BY f) AS rk, count(*) OVER () AS n FROM firsts),
tiers AS (SELECT SUBJECT_ID, CASE WHEN rk <= round_even(n * {low}::DOUBLE, 0) THEN 1
                                  WHEN rk <= round_even(n * {high}::DOUBLE, 0) THEN 2 ELSE 100 END AS cap FROM ranked),
capped AS (SELECT charts.* FROM charts JOIN tiers USING (SUBJECT_ID)
           QUALIFY row_number() OVER (PARTITION BY charts.SUBJECT_ID ORDER BY chart_key) <= cap)"""


@query("cohort_small", cohort_sql(FIRST_PER_STAY, 4))
def cohort_small(spark, d):
    return build_cohort(tables(spark, d), "small", draws())


@query("cohort_medium", cohort_sql(tier_rule(0.3, 0.9), None))
def cohort_medium(spark, d):
    return build_cohort(tables(spark, d), "medium", draws())


@query("cohort_large", cohort_sql(tier_rule(0.3, 0.7), None))
def cohort_large(spark, d):
    return build_cohort(tables(spark, d), "large", draws())
