"""Projections, joins, dedup, set operations and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalar import uniform_int
from tabloom.operators import dates, dedup, joins, shape

from .base import LINE_CATEGORICAL, LINE_KEY, given_u, load, query, sql_u

KEYS = ", ".join(LINE_KEY)


def line(spark, d):
    return load(spark, d, "lineitem")


# --- projections, casts, filters -------------------------------------------

@query("project_cols", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def project_cols(spark, d):
    return shape.project(line(spark, d), ["l_orderkey", "l_partkey", "l_quantity"])


@query("rename_col", "SELECT o_orderkey AS x14, o_custkey, o_totalprice FROM orders")
def rename_col(spark, d):
    df = shape.project(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return shape.rename(df, {"o_orderkey": "x14"})


@query("cast_int_cols", """
SELECT l_orderkey, trunc(l_quantity)::INTEGER AS l_quantity, trunc(l_extendedprice)::INTEGER AS l_extendedprice
FROM lineitem""")
def cast_int_cols(spark, d):
    df = shape.project(line(spark, d), ["l_orderkey", "l_quantity", "l_extendedprice"])
    return shape.cast_columns(df, ["l_quantity", "l_extendedprice"], "int")


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_cols(spark, d):
    return load(spark, d, "orders").drop("o_orderdate", "o_orderpriority")


@query("drop_null_cols", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def drop_null_cols(spark, d):
    df = line(spark, d).select(
        "l_orderkey", "l_linenumber", "l_tax",
        F.nullif("l_quantity", F.lit(1.0)).alias("quantity_gaps"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag_gaps"))
    return shape.drop_null_columns(df)


STAYS_SQL = """
SELECT o_orderkey, o_orderdate AS admit, l_shipdate AS chart,
       o_orderdate + to_days((o_orderkey % 30 + 1)::INTEGER) AS discharge, l_linenumber, l_partkey, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def stay_rows(spark, d):
    orders = load(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("admit"),
        dates.add_days(F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(30)) + 1).alias("discharge"))
    lines = line(spark, d).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("chart"),
        "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.join(orders, "o_orderkey")


@query("filter_chronology", f"SELECT * FROM ({STAYS_SQL}) WHERE admit < chart AND discharge > chart")
def filter_chronology(spark, d):
    from tabloom.plans.cohort import chronology

    return stay_rows(spark, d).where(chronology("admit", "chart", "discharge"))


RULES_SQL = {"quantity": "l_quantity > 25", "discount": "l_discount <= 0.05", "shipped": "l_shipdate >= TIMESTAMP '1998-01-01'"}


def rules():
    return {
        "quantity": F.col("l_quantity") > 25,
        "discount": F.col("l_discount") <= 0.05,
        "shipped": F.col("l_shipdate") >= dates.ntz("1998-01-01 00:00:00"),
    }


@query("rule_filter_any", f"SELECT {KEYS}, l_quantity, l_discount FROM lineitem WHERE {' OR '.join(RULES_SQL.values())}")
def rule_filter_any(spark, d):
    kept = shape.rule_filter(line(spark, d), list(rules().values()), "any")
    return kept.select(*LINE_KEY, "l_quantity", "l_discount")


@query("rule_filter_all", f"SELECT {KEYS}, l_quantity, l_discount FROM lineitem WHERE {' AND '.join(RULES_SQL.values())}")
def rule_filter_all(spark, d):
    kept = shape.rule_filter(line(spark, d), list(rules().values()), "all")
    return kept.select(*LINE_KEY, "l_quantity", "l_discount")


@query("rule_report", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({s}, false)) AS violations, count(*) AS rows FROM lineitem"
    for n, s in RULES_SQL.items()))
def rule_report(spark, d):
    return shape.rule_report(line(spark, d), rules())


@query("fillna_zero", f"SELECT {KEYS}, coalesce(nullif(l_quantity, 10), 0) AS quantity, "
       "coalesce(nullif(l_tax, 0.05), 0) AS tax FROM lineitem")
def fillna_zero(spark, d):
    return line(spark, d).select(
        *LINE_KEY, F.nullif("l_quantity", F.lit(10.0)).alias("quantity"),
        F.nullif("l_tax", F.lit(0.05)).alias("tax")).fillna(0.0, ["quantity", "tax"])


@query("align_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def align_columns(spark, d):
    orders = load(spark, d, "orders")
    like = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return shape.align_columns(orders.select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey"), like)


@query("cast_categorical", "SELECT l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_suppkey::VARCHAR AS l_suppkey FROM lineitem")
def cast_categorical(spark, d):
    df = line(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey")
    return shape.cast_categorical(df, ["l_linenumber", "l_suppkey"])


@query("category_widths", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS width FROM lineitem" for c in [*LINE_CATEGORICAL, "l_suppkey"]))
def category_widths(spark, d):
    return shape.category_widths(line(spark, d), [*LINE_CATEGORICAL, "l_suppkey"])


# --- joins -----------------------------------------------------------------

@query("natural_join", """
SELECT o_custkey AS subject_id, o_orderkey, o_orderstatus, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def natural_join(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderkey", "o_orderstatus")
    people = load(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    return joins.natural_join(orders, people)


@query("natural_join_fanout", """
SELECT a.o_custkey AS subject_id, a.o_orderkey AS admission, a.o_orderstatus AS status,
       s.o_orderkey AS stay, s.o_orderpriority AS unit
FROM orders a JOIN orders s ON a.o_custkey = s.o_custkey""")
def natural_join_fanout(spark, d):
    orders = load(spark, d, "orders")
    admissions = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("admission"),
                               F.col("o_orderstatus").alias("status"))
    stays = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay"),
                          F.col("o_orderpriority").alias("unit"))
    return joins.natural_join(admissions, stays, balance=True)


@query("join_composite", """
SELECT o_custkey AS subject_id, o_orderkey AS stay_id, o_orderpriority AS unit, l_partkey, l_quantity
FROM orders JOIN (SELECT o_custkey AS s, l_orderkey AS k, l_partkey, l_quantity
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e
ON o_custkey = e.s AND o_orderkey = e.k""")
def join_composite(spark, d):
    orders = load(spark, d, "orders")
    stays = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"),
                          F.col("o_orderpriority").alias("unit"))
    owner = orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"))
    charts = line(spark, d).select(F.col("l_orderkey").alias("stay_id"), "l_partkey", "l_quantity")
    charts = charts.join(owner, "stay_id")
    return joins.composite_join(charts, stays, ["subject_id", "stay_id"], balance=True)


@query("join_lookup", """
SELECT l_partkey AS item_id, p_type AS label, l_orderkey, l_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_lookup(spark, d):
    rows = line(spark, d).select(F.col("l_partkey").alias("item_id"), "l_orderkey", "l_quantity")
    items = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("label"))
    return joins.lookup_join(rows, items, ["item_id"])


# --- dedup, heads, caps, set operations --------------------------------------

@query("dedup_keep_first", f"""
SELECT {KEYS}, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedup_keep_first(spark, d):
    df = line(spark, d).select(*LINE_KEY, "l_quantity")
    return dedup.keep_first(df, ["l_orderkey"], LINE_KEY[1:])


@query("group_head", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 4""")
def group_head(spark, d):
    df = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return dedup.group_head(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4)


def tiered_sql(low: float, high: float) -> str:
    return f"""
WITH firsts AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id),
ranked AS (SELECT user_id, row_number() OVER (ORDER BY first_id) AS rk, count(*) OVER () AS n FROM firsts),
tiers AS (SELECT user_id, CASE WHEN rk <= round_even(n * {low}::DOUBLE, 0) THEN 1
                               WHEN rk <= round_even(n * {high}::DOUBLE, 0) THEN 2 ELSE 100 END AS cap FROM ranked),
numbered AS (SELECT event_id, user_id, event_type, value,
                    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT event_id, numbered.user_id, event_type, value FROM numbered JOIN tiers USING (user_id) WHERE rn <= cap"""


def tiered(spark, d, shares):
    df = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return dedup.tiered_cap(df, "user_id", "event_id", shares, [1, 2, 100])


@query("tiered_cap_medium", tiered_sql(0.3, 0.9))
def tiered_cap_medium(spark, d):
    return tiered(spark, d, [0.3, 0.9])


@query("tiered_cap_large", tiered_sql(0.3, 0.7))
def tiered_cap_large(spark, d):
    return tiered(spark, d, [0.3, 0.7])


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return dedup.distinct_rows(line(spark, d), ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("distinct_first_seen", "SELECT user_id AS value, min(event_id) AS first_order FROM events GROUP BY user_id")
def distinct_first_seen(spark, d):
    return dedup.first_seen(load(spark, d, "events"), "user_id", "event_id")


@query("union_all", """
SELECT o_custkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer""")
def union_all(spark, d):
    a = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = load(spark, d, "customer").select(F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("id"))
    return dedup.append_all([a, b])


@query("trim_to_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def trim_to_n(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return dedup.trim_to(df, 500, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("value_counts", "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def value_counts(spark, d):
    return dedup.value_counts(line(spark, d), "l_suppkey")


# --- dates -----------------------------------------------------------------

# text dates in day/month/year form, with every 7th a bad month and every 11th missing
DATE_TEXT_SQL = """CASE WHEN o_orderkey % 11 = 0 THEN NULL
 WHEN o_orderkey % 7 = 0 THEN '31/13/' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END"""


@query("parse_datetime", f"""
SELECT o_orderkey, text_date, CASE WHEN text_date IS NULL OR text_date LIKE '31/13/%' THEN NULL ELSE o_orderdate END AS parsed
FROM (SELECT o_orderkey, o_orderdate, {DATE_TEXT_SQL} AS text_date FROM orders)""")
def parse_datetime(spark, d):
    text = (F.when(F.pmod("o_orderkey", F.lit(11)) == 0, F.lit(None))
            .when(F.pmod("o_orderkey", F.lit(7)) == 0, F.concat(F.lit("31/13/"), F.date_format("o_orderdate", "yyyy")))
            .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    df = load(spark, d, "orders").select("o_orderkey", text.alias("text_date"))
    return df.withColumn("parsed", dates.parse_datetime("text_date", "dd/MM/yyyy"))


REF = "TIMESTAMP '2021-12-01'"
BIRTH_SQL = "(TIMESTAMP '1900-01-01' + to_days(((c_custkey * 37) % 60000)::INTEGER))"


def birth(key: str = "c_custkey"):
    days = F.pmod(F.col(key) * 37, F.lit(60000))
    return dates.add_days(dates.ntz("1900-01-01 00:00:00"), days)


def sql_year_ends(start: str, end: str) -> str:
    return (f"greatest(0, year({end}) - year({start}) + "
            f"(CASE WHEN {end} >= make_timestamp(year({end}), 12, 31, 0, 0, 0) THEN 1 ELSE 0 END))")


@query("year_ends_between", f"""
SELECT c_custkey, ({sql_year_ends(BIRTH_SQL, REF)})::INTEGER AS behind, ({sql_year_ends(REF, BIRTH_SQL)})::INTEGER AS ahead
FROM customer""")
def year_ends_between(spark, d):
    ref = dates.ntz(dates.REFERENCE_DATE)
    return load(spark, d, "customer").select(
        "c_custkey", dates.year_ends_between(birth(), ref).alias("behind"),
        dates.year_ends_between(ref, birth()).alias("ahead"))


def sql_steps(start: str, end: str, unit: int) -> str:
    gap = f"(epoch_us({end}) - epoch_us({start}))"
    return f"(CASE WHEN {gap} >= 0 THEN floor({gap} / {unit}::DOUBLE)::BIGINT + 1 ELSE 0 END)::BIGINT"


def shipped_pairs(spark, d):
    lines = line(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey")


@query("day_steps", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {sql_steps('o_orderdate', 'l_shipdate', dates.DAY_MICROS)} AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def day_steps(spark, d):
    return shipped_pairs(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", dates.day_steps(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("second_steps", f"""
SELECT event_id, {sql_steps("TIMESTAMP '2024-01-10 06:00:00'", 'ts', dates.SECOND_MICROS)} AS seconds FROM events""")
def second_steps(spark, d):
    start = dates.ntz("2024-01-10 06:00:00")
    return load(spark, d, "events").select("event_id", dates.second_steps(start, F.col("ts")).alias("seconds"))


@query("rand_int_range", f"""
SELECT o_orderkey, (o_custkey + floor({sql_u('o_orderkey', 5)} * 50::DOUBLE))::BIGINT AS drawn FROM orders""")
def rand_int_range(spark, d):
    lo = F.col("o_custkey")
    return load(spark, d, "orders").select(
        "o_orderkey", uniform_int(given_u("o_orderkey", 5), lo, lo + 50).alias("drawn"))


REBASE_SQL = f"""
SELECT c_custkey, birth, yrs::BIGINT AS dob_offset, (birth + to_years(yrs::INTEGER))::TIMESTAMP AS dob
FROM (SELECT c_custkey, birth,
   CASE WHEN behind <> 0 AND birth < TIMESTAMP '1930-01-01' THEN (behind - 80) + floor(u * 40::DOUBLE)
        WHEN ahead <> 0 AND birth > {REF} THEN -((ahead + 30) + floor(u * 20::DOUBLE)) ELSE 0 END AS yrs
  FROM (SELECT c_custkey, birth, {sql_year_ends('birth', REF)} AS behind, {sql_year_ends(REF, 'birth')} AS ahead,
               {sql_u('c_custkey', 1)} AS u
        FROM (SELECT c_custkey, {BIRTH_SQL} AS birth FROM customer)))"""


@query("rebase_dob", f"SELECT c_custkey, dob, dob_offset FROM ({REBASE_SQL})")
def rebase_dob(spark, d):
    df = load(spark, d, "customer").select("c_custkey", birth().alias("dob"))
    return dates.rebase_birth_date(df, "dob", given_u("c_custkey", 1), "dob_offset")


def shift_sql(source: str, key: str) -> str:
    """SQL twin of the stay-time shift over columns dob, admit, discharge and a row key."""
    return f"""
SELECT * EXCLUDE (dn, sn, ad, sd, cs), dob + to_days(ad::INTEGER) AS new_admit,
       dob + to_days(ad::INTEGER) + to_days(sd::INTEGER) AS new_discharge,
       dob + to_days(ad::INTEGER) + to_seconds(cs::BIGINT) AS new_chart
FROM (SELECT *, round_even(dn * 0.25::DOUBLE, 0) + floor({sql_u(key, 2)} *
                 ((round_even(dn * 0.9::DOUBLE, 0) + 5) - round_even(dn * 0.25::DOUBLE, 0))) AS ad,
             floor({sql_u(key, 3)} * 50::DOUBLE) AS sd,
             (round_even(sn * 0.01::DOUBLE, 0) + 1) + floor({sql_u(key, 4)} *
                 ((round_even(sn * 0.99::DOUBLE, 0) + 10) - (round_even(sn * 0.01::DOUBLE, 0) + 1))) AS cs
      FROM (SELECT *, {sql_steps('dob', REF, dates.DAY_MICROS)} AS dn,
                   {sql_steps('admit', 'discharge', dates.SECOND_MICROS)} AS sn FROM ({source})))"""


@query("shift_stay_times", "SELECT o_orderkey, new_admit AS admit, new_discharge AS discharge, new_chart AS chart FROM ("
       + shift_sql(f"""
SELECT o_orderkey, dob, o_orderdate AS admit, o_orderdate + to_days((o_orderkey % 30 + 1)::INTEGER) AS discharge
FROM orders JOIN ({REBASE_SQL}) ON o_custkey = c_custkey""", "o_orderkey") + ")")
def shift_stay_times(spark, d):
    people = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), birth().alias("dob"))
    people = dates.rebase_birth_date(people, "dob", given_u("o_custkey", 1))
    stays = load(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").alias("admit"),
        dates.add_days(F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(30)) + 1).alias("discharge"))
    moved = dates.shift_stay_times(
        stays.join(people, "o_custkey"), "dob", "admit", "discharge", "chart",
        given_u("o_orderkey", 2), given_u("o_orderkey", 3), given_u("o_orderkey", 4))
    return moved.select("o_orderkey", "admit", "discharge", "chart")


AGE_SQL = "floor((epoch_us({ref}) - epoch_us({dob})) / (365.2425::DOUBLE * 86400000000))::INTEGER"


@query("age_years", f"SELECT c_custkey, {AGE_SQL.format(ref=REF, dob=BIRTH_SQL)} AS age FROM customer")
def age_years(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey", dates.age_years(birth(), dates.ntz(dates.REFERENCE_DATE)).alias("age"))
