"""Whole-table encoders: inference, fitted state, transform, reverse, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.categorical import OneHotEncoder
from tabloom.operators.fields import DatePartsEncoder, JointEncoder
from tabloom.operators.mixture import MixtureEncoder
from tabloom.operators.shape import block_order, project
from tabloom.operators.store import load_encoder, save_encoder
from tabloom.operators.table import TableEncoder, infer_types
from tabloom.plans.flat import FlatEncoder
from tabloom.roles import ColumnRoles
from tabloom.sources.io import scratch

from .base import LINE_NUMERIC, load, query, r, sql_r
from .encoders import GAPS, ID, IDS, MIXTURE, gaps, state

EVENT_TYPES = {"event_id": "integer", "ts": "datetime", "user_id": "categorical", "event_type": "categorical",
               "value": "float", "props": "categorical"}


@query("infer_types", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM events" for c, t in EVENT_TYPES.items()))
def infer_types_query(spark, d):
    df = load(spark, d, "events")
    types = infer_types(df, {"user_id": "categorical"})
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(c).alias("non_null"))
                      for c, t in types.items()])
    return counts.select(F.explode(items).alias("x")).select("x.*")


FIELDS = ["q", "n", "ts", "b", "s"]


def fitted(spark, d):
    df = project(gaps(spark, d), [*ID, *FIELDS])
    return df, TableEncoder(keep=tuple(ID)).fit(df)


@query("table_fit", f"""
SELECT 'q' AS field, 'fill' AS name, {sql_r('avg(q)')} AS value FROM {GAPS}
UNION ALL SELECT 'n', 'fill', {sql_r('avg(n)')} FROM {GAPS}
UNION ALL SELECT 'ts', 'fill', {sql_r('avg(epoch_us(ts)) / 1e9', 3)} FROM {GAPS}
UNION ALL SELECT 'b', 'fill', -1.0::DOUBLE
UNION ALL SELECT 's', 'categories', (SELECT count(DISTINCT s) + 1 FROM {GAPS})::DOUBLE
UNION ALL SELECT x, 'nulls', 1.0::DOUBLE FROM (VALUES ('q'), ('n'), ('ts'), ('b')) t(x)""")
def table_fit(spark, d):
    _, t = fitted(spark, d)
    rows = []
    for name, e, _ in t.steps:
        if name == "s":
            rows.append((name, "categories", float(e.cats.size)))
            continue
        fill = e.null.value / 1e9 if name == "ts" else e.null.value
        rows += [(name, "fill", round(float(fill), 3 if name == "ts" else 6)), (name, "nulls", float(e.null.nulls))]
    return state(spark, rows, "field string, name string, value double")


@query("table_transform", f"""
WITH i AS (SELECT value, (2 * cum - n)::DOUBLE / (2 * total) AS mid FROM (
   SELECT s AS value, count(*) AS n, sum(count(*)) OVER () AS total,
          sum(count(*)) OVER (ORDER BY count(*) DESC, s NULLS LAST ROWS UNBOUNDED PRECEDING) AS cum FROM {GAPS} GROUP BY s)),
m AS (SELECT avg(q) AS q, avg(n) AS n, avg(epoch_us(ts)) AS ts FROM {GAPS})
SELECT {IDS}, {sql_r('coalesce(g.q, m.q)')} AS q__value, (g.q IS NULL)::INTEGER::DOUBLE AS q__is_null,
  {sql_r('coalesce(g.n, m.n)')} AS n__value, (g.n IS NULL)::INTEGER::DOUBLE AS n__is_null,
  {sql_r('coalesce(epoch_us(g.ts)::DOUBLE, m.ts) / 1e9', 3)} AS ts__value, (g.ts IS NULL)::INTEGER::DOUBLE AS ts__is_null,
  coalesce(b::INTEGER::DOUBLE, -1) AS b__value, (b IS NULL)::INTEGER::DOUBLE AS b__is_null, {sql_r('mid', 9)} AS s__value
FROM {GAPS} g JOIN i ON g.s IS NOT DISTINCT FROM i.value, m""")
def table_transform(spark, d):
    df, t = fitted(spark, d)
    out = t.transform(df)
    rounded = {"q__value": r(F.col("q__value")), "n__value": r(F.col("n__value")),
               "ts__value": r(F.col("ts__value") / 1e9, 3), "s__value": r(F.col("s__value"), 9)}
    return out.withColumns(rounded)


@query("table_roundtrip", f"SELECT {IDS}, {', '.join(FIELDS)} FROM {GAPS}")
def table_roundtrip(spark, d):
    df, t = fitted(spark, d)
    return t.reverse_transform(t.transform(df))


LINEAGE = [
    ("q", "NumericEncoder", "q__value"), ("q", "NumericEncoder", "q__is_null"),
    ("price", "MixtureEncoder", "price__normalized"), ("price", "MixtureEncoder", "price__component"),
    ("price__component", "OneHotEncoder", "price__component__value0"),
    ("price__component", "OneHotEncoder", "price__component__value1"),
    ("price__component", "OneHotEncoder", "price__component__value2"),
    ("f", "OneHotEncoder", "f__value0"), ("f", "OneHotEncoder", "f__value1"), ("f", "OneHotEncoder", "f__value2"),
]


# each fitted output, with the number of rows transformed
@query("table_lineage", f"""
SELECT field, encoder, output, rows FROM (VALUES {', '.join(map(repr, LINEAGE))}) t(field, encoder, output),
 (SELECT count(*) AS rows FROM lineitem)""")
def table_lineage(spark, d):
    df = project(gaps(spark, d), ["q", "price", "f"])
    mixture = MixtureEncoder(selection="argmax").with_parameters(MIXTURE)
    t = TableEncoder({"price": mixture, "f": OneHotEncoder()}).fit(df)
    return t.lineage(spark).withColumn("rows", F.lit(t.transform(df).count()).cast("bigint"))


# --- block order and the flat pipelines -------------------------------------

FLAT_ROLES = ColumnRoles(categorical=("l_returnflag", "l_linestatus", "l_linenumber"), continuous=tuple(LINE_NUMERIC))
LEVELS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"], "l_linenumber": list(range(1, 8))}


def onehot_sql(column: str) -> list[str]:
    return [f"({column} = {v!r})::INTEGER AS {column}__value{i}" for i, v in enumerate(LEVELS[column])]


def scaled_sql(c: str, alias: str | None = None) -> str:
    return sql_r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {alias or c}__value"


ROW_ID = ["l_orderkey", "l_partkey", "l_suppkey"]
FLAT_SQL = f"""SELECT {', '.join(ROW_ID)}, {', '.join(x for c in LEVELS for x in onehot_sql(c))},
 {', '.join(scaled_sql(c) for c in LINE_NUMERIC)} FROM lineitem"""


@query("encode_block_order", f"""
SELECT l_orderkey, l_partkey, l_suppkey, {', '.join(onehot_sql('l_linestatus'))}, l_quantity, l_tax FROM lineitem""")
def encode_block_order(spark, d):
    df = load(spark, d, "lineitem").select(*ROW_ID, "l_quantity", "l_linestatus", "l_tax")
    e = OneHotEncoder().fit(df, "l_linestatus")
    return block_order(e.transform(df, "l_linestatus"), e.output_columns("l_linestatus"), ["l_quantity", "l_tax"], ROW_ID)


def survival(method: str, **options) -> FlatEncoder:
    roles = ColumnRoles(categorical=FLAT_ROLES.categorical, continuous=("quantity", *LINE_NUMERIC[1:]))
    return FlatEncoder(roles, method, rename={"l_quantity": "quantity"}, integers=("l_linenumber",),
                       keep=tuple(ROW_ID), **options)


@query("encode_survival_standard", FLAT_SQL.replace("l_quantity__value", "quantity__value"))
def encode_survival_standard(spark, d):
    df = load(spark, d, "lineitem")
    e = survival("standard").fit(df)
    return e.encode(df).withColumns({c: r(F.col(c)) for c in e.continuous_outputs})


@query("encode_survival_mixture")
def encode_survival_mixture(spark, d):
    df = load(spark, d, "lineitem")
    return survival("mixture").fit(df).encode(df)


CLINICAL = ColumnRoles(categorical=("o_orderstatus", "o_orderpriority", "l_returnflag"), continuous=("l_quantity", "l_tax"),
                       datetime=("o_orderdate", "l_shipdate"))
CLINICAL_LEVELS = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
                   "l_returnflag": ["A", "N", "R"]}
CLINICAL_SQL = f"(SELECT {', '.join(ROW_ID)}, {', '.join(CLINICAL.columns())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def clinical_rows(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    lines = load(spark, d, "lineitem").select(*ROW_ID, "l_returnflag", "l_quantity", "l_tax", "l_shipdate")
    return lines.join(orders, "l_orderkey").select(*ROW_ID, *CLINICAL.columns())


@query("encode_clinical_standard", f"""
SELECT {', '.join(ROW_ID)},
 {', '.join(f"({c} = '{v}')::INTEGER AS {c}__value{i}" for c, vs in CLINICAL_LEVELS.items() for i, v in enumerate(vs))},
 {scaled_sql('l_quantity')}, {scaled_sql('l_tax')}, {scaled_sql('epoch_us(o_orderdate)', 'o_orderdate')},
 {scaled_sql('epoch_us(l_shipdate)', 'l_shipdate')} FROM {CLINICAL_SQL}""")
def encode_clinical_standard(spark, d):
    df = clinical_rows(spark, d)
    e = FlatEncoder(CLINICAL, "standard", keep=tuple(ROW_ID)).fit(df)
    return e.encode(df).withColumns({c: r(F.col(c)) for c in e.continuous_outputs})


@query("decode_clinical", f"""
SELECT {', '.join(ROW_ID)}, {', '.join(CLINICAL.categorical)}, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax,
 o_orderdate, l_shipdate FROM {CLINICAL_SQL}""")
def decode_clinical(spark, d):
    df = clinical_rows(spark, d)
    e = FlatEncoder(CLINICAL, "standard", keep=tuple(ROW_ID)).fit(df)
    out = e.decode(e.encode(df))
    # scaling a microsecond count in doubles is exact to about a second over decades
    stamps = {c: F.date_trunc("day", F.col(c) + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz") for c in CLINICAL.datetime}
    return out.withColumns({c: F.round(c, 6) for c in CLINICAL.continuous} | stamps)


@query("metric_view", f"""
SELECT {', '.join(ROW_ID)}, {', '.join(CLINICAL.categorical)}, l_quantity, l_tax,
 epoch_us(o_orderdate)::DOUBLE AS o_orderdate, epoch_us(l_shipdate)::DOUBLE AS l_shipdate FROM {CLINICAL_SQL}""")
def metric_view(spark, d):
    df = clinical_rows(spark, d)
    return FlatEncoder(CLINICAL, "standard", keep=tuple(ROW_ID)).fit(df).metric_view(df)


# --- saved encoders, wide one-hots, fields of several columns --------------------

# orders and parts as text: more categories than one-hot columns, or than literals
WIDE_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey::VARCHAR AS order_text, l_partkey::VARCHAR AS part_text, l_returnflag, l_quantity, l_shipdate"
WIDE_ROLES = ColumnRoles(categorical=("order_text", "part_text", "l_returnflag"), continuous=("l_quantity",), datetime=("l_shipdate",))
WIDE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def wide_rows(spark, d):
    return load(spark, d, "lineitem").select(
        *WIDE_KEYS, F.col("l_orderkey").cast("string").alias("order_text"), F.col("l_partkey").cast("string").alias("part_text"),
        "l_returnflag", "l_quantity", "l_shipdate")


@query("encoder_roundtrip", f"{WIDE_SQL} FROM lineitem")
def encoder_roundtrip(spark, d):
    df = wide_rows(spark, d)
    path = scratch(spark, "encoder")
    save_encoder(spark, FlatEncoder(WIDE_ROLES, "standard", keep=WIDE_KEYS).fit(df), path)
    other = spark.newSession()
    e = load_encoder(other, path)
    out = e.decode(e.encode(wide_rows(other, d)))
    day = F.date_trunc("day", F.col("l_shipdate") + F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")
    return out.withColumns({"l_quantity": F.round("l_quantity", 6), "l_shipdate": day})


@query("onehot_wide", """
WITH k AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT l_orderkey::VARCHAR AS p FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, i::INTEGER AS position, 1.0::DOUBLE AS value, p AS order_text
FROM lineitem JOIN k ON k.p = l_orderkey::VARCHAR""")
def onehot_wide(spark, d):
    df = wide_rows(spark, d).select(*WIDE_KEYS, "order_text")
    e = OneHotEncoder(limit=100).fit(df, "order_text")
    encoded = e.transform(df, "order_text")
    cell = F.get("order_text__value", 0)
    kept = encoded.withColumns({"position": cell["i"], "value": cell["v"]})
    return e.decode(kept, "order_text", "order_text").drop("order_text__value")


FIELD_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, nullif(l_linestatus, 'F') AS l_linestatus,
 year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, day(l_shipdate)::INTEGER AS d FROM lineitem)"""


def field_rows(spark, d):
    return load(spark, d, "lineitem").select(
        *WIDE_KEYS, "l_returnflag", F.nullif("l_linestatus", F.lit("F")).alias("l_linestatus"),
        F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d"))


def field_encoder() -> TableEncoder:
    return TableEncoder({("l_returnflag", "l_linestatus"): JointEncoder(), ("y", "m", "d"): DatePartsEncoder()}, keep=WIDE_KEYS)


@query("field_transform", f"""
WITH i AS (SELECT l_returnflag AS f, l_linestatus AS s, (2 * cum - n)::DOUBLE / (2 * total) AS mid FROM (
   SELECT l_returnflag, l_linestatus, count(*) AS n, sum(count(*)) OVER () AS total, sum(count(*)) OVER (
     ORDER BY count(*) DESC, l_returnflag, l_linestatus NULLS LAST ROWS UNBOUNDED PRECEDING) AS cum FROM {FIELD_SQL} GROUP BY l_returnflag, l_linestatus))
SELECT l_orderkey, l_linenumber, l_partkey, {sql_r('mid', 9)} AS pair, (epoch_us(make_date(y, m, d)) / 86400000000)::BIGINT AS day
FROM {FIELD_SQL} x JOIN i ON x.l_returnflag = i.f AND x.l_linestatus IS NOT DISTINCT FROM i.s""")
def field_transform(spark, d):
    df = field_rows(spark, d)
    out = field_encoder().fit_transform(df)
    return out.select(*WIDE_KEYS, r(F.col("`l_returnflag#l_linestatus__value__value`"), 9).alias("pair"),
                      (F.col("`y#m#d__value__value`") / 86_400_000_000).cast("bigint").alias("day"))


@query("field_roundtrip", f"SELECT * FROM {FIELD_SQL}")
def field_roundtrip(spark, d):
    df = field_rows(spark, d)
    t = field_encoder().fit(df)
    return t.reverse_transform(t.transform(df))
