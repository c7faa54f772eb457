"""Column generators applied to the keys of orders, checked with a given uniform."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.sources import generators as G

from .base import given_u, load, query, r, sql_r, sql_u
from .encoders import sql_ppf

U0, U1 = sql_u("o_orderkey", 20), sql_u("o_orderkey", 21)
SHARE = 0.3


def pick_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][floor(u0 * {len(values)})::INTEGER + 1]"


BASE = f"TIMESTAMP '{G.BASE_TIME}'"
TOP_DAYS = f"date_diff('day', {BASE}, TIMESTAMP '{G.MAX_TIME}')"
SQL = {
    "random_boolean": "u0 < 0.5",
    "random_skewed_boolean": f"u0 < {G.TRUE_SHARE}::DOUBLE",
    "constant_boolean": "true",
    "categorical_random_integer": "(1 + floor(u0 * 5))::BIGINT",
    "random_string": pick_sql(G.NAMES),
    "random_mixed": pick_sql(G.MIXED),
    "single_integer": f"{G.CONSTANT}::BIGINT",
    "single_string": f"'{G.NAMES[0]}'",
    "unique_integer": "o_orderkey",
    "unique_string": "o_orderkey::VARCHAR",
    "random_gap_datetime": f"{BASE} + to_microseconds(floor(u0 * 86400000000::DOUBLE)::BIGINT)",
    "random_gap_seconds_datetime": f"{BASE} + to_microseconds(floor(u0 * 1000000::DOUBLE)::BIGINT)",
    "equal_gap_hours_datetime": f"{BASE} + to_hours(o_orderkey)",
    "equal_gap_days_datetime": f"{BASE} + to_days(least(o_orderkey, {TOP_DAYS})::INTEGER)",
    "equal_gap_weeks_datetime": f"{BASE} + to_days((7 * least(o_orderkey, floor({TOP_DAYS} / 7.0)))::INTEGER)",
    "numerical_random_integer": f"(floor(u0 * {G.INT_SPAN}::DOUBLE) + {G.INT_LOW})::BIGINT",
    "constant_integer": f"{G.CONSTANT}::BIGINT",
    "almost_constant_integer": f"(CASE WHEN o_orderkey = 0 THEN {G.OTHER} ELSE {G.CONSTANT} END)::BIGINT",
    "normal": sql_r(sql_ppf("u0")),
    "big_normal": sql_r(f"{sql_ppf('u0')} * {G.BIG_SCALE}::DOUBLE", 3),
}


def generated(name: str):
    def run(spark, d):
        keys = load(spark, d, "orders").select("o_orderkey")
        out = G.add_column(keys, name, "o_orderkey", lambda salt: given_u("o_orderkey", 20 + salt), SHARE)
        digits = {"normal": 6, "big_normal": 3}.get(name.removesuffix("_nans"))
        return out.withColumn("value", r(F.col("value"), digits)) if digits else out
    return run


for _name, _g in G.GENERATORS.items():
    _value = SQL[_name.removesuffix("_nans")]
    if _g.nulls:
        _value = f"CASE WHEN u1 >= {SHARE}::DOUBLE THEN {_value} END"
    query(f"gen_{_name}", f"SELECT o_orderkey, {_value} AS value FROM (SELECT o_orderkey, {U0} AS u0, {U1} AS u1 FROM orders)")(generated(_name))


DEMO = {
    "0_int": "floor(u0 * 100)::DOUBLE", "1_float": "u1 * 100", "2_str": pick_sql(["a", "b", "c", "d"]).replace("u0", "u2"),
    "3_datetime": f"{BASE} + to_days(floor(u3 * 3650)::INTEGER)",
}


# the fifth of the rows with the smallest lots is null, in each column by lots of its own
@query("demo_table", f"""
SELECT o_orderkey, {', '.join(f'CASE WHEN lot{i} > floor(n / 5) THEN {x} END AS "{c}"' for i, (c, x) in enumerate(DEMO.items()))}
FROM (SELECT o_orderkey, count(*) OVER () AS n, {', '.join(
    f"{sql_u('o_orderkey', i)} AS u{i}, row_number() OVER (ORDER BY {sql_u('o_orderkey', 100 + i)}) AS lot{i}" for i in range(len(DEMO)))}
  FROM orders)""")
def demo_table(spark, d):
    keys = load(spark, d, "orders").select("o_orderkey")
    return G.demo_columns(keys, "o_orderkey", keys.count(), draw=lambda number: given_u("o_orderkey", number))
