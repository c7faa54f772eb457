"""Reversible column encoders over tables with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalar as M
from tabloom.functions.scalar import (
    EPSILON, PHI_DENOMINATOR, PHI_NUMERATOR, PHI_SWITCH, SQRT_TWO_PI, with_normal_cdf,
)
from tabloom.operators import categorical as C
from tabloom.operators import copula
from tabloom.operators.encoder import fit_all
from tabloom.operators.mixture import PROBABILITY_FLOOR, MixtureEncoder, fit_mixtures
from tabloom.operators.numeric import (
    BooleanEncoder, BoundedEncoder, DatetimeEncoder, IdentityEncoder, NullEncoder, NumericEncoder,
    RoundedBoundedEncoder, RoundedEncoder, StandardEncoder, divider_candidates, rounding_aggs, rounding_digits,
)
from tabloom.operators.shape import project

from .base import given_u, load, query, r, sql_half_even, sql_r, sql_u

ID = ["l_orderkey", "l_linenumber", "l_partkey"]
IDS = ", ".join(ID)

# lineitem with gaps in a number, an integer, a text, a timestamp and a boolean
GAPS = f"""(SELECT {IDS}, l_extendedprice AS price, l_discount AS disc, nullif(l_quantity, 25) AS q,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS n, nullif(l_returnflag, 'R') AS f,
 nullif(l_suppkey::VARCHAR, '7') AS s, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS ts,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag = 'A' END AS b, l_quantity, l_suppkey, l_shipdate
 FROM lineitem)"""


def gaps(spark, d):
    third = F.col("l_linenumber") == 3
    return load(spark, d, "lineitem").select(
        *ID, F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
        F.nullif("l_quantity", F.lit(25.0)).alias("q"), F.when(~third, F.col("l_suppkey")).alias("n"),
        F.nullif("l_returnflag", F.lit("R")).alias("f"),
        F.nullif(F.col("l_suppkey").cast("string"), F.lit("7")).alias("s"),
        F.when(~third, F.col("l_shipdate")).alias("ts"),
        F.when(F.col("l_linenumber") != 2, F.col("l_returnflag") == "A").alias("b"),
        "l_quantity", "l_suppkey", "l_shipdate")


def state(spark, rows, schema):
    """A fitted state (a handful of numbers) as a table."""
    return spark.createDataFrame(rows, schema)


# --- nulls -----------------------------------------------------------------

@query("null_fit_mean", f"SELECT true AS nulls, {sql_r('avg(q)')} AS fill, true AS indicator FROM {GAPS}")
def null_fit_mean(spark, d):
    e = NullEncoder("mean").fit(project(gaps(spark, d), ["q"]), "q").null
    return state(spark, [(e.nulls, round(e.value, 6), e.has_indicator)], "nulls boolean, fill double, indicator boolean")


@query("null_fit_mode", f"""
SELECT true AS nulls, f AS fill, true AS indicator FROM {GAPS} WHERE f IS NOT NULL
GROUP BY f ORDER BY count(*) DESC, f LIMIT 1""")
def null_fit_mode(spark, d):
    e = NullEncoder(None).fit(project(gaps(spark, d), ["f"]), "f").null
    return state(spark, [(e.nulls, e.value, e.has_indicator)], "nulls boolean, fill string, indicator boolean")


@query("null_fit_const", f"SELECT count(*) > count(q) AS nulls, -1.0::DOUBLE AS fill, false AS indicator FROM {GAPS}")
def null_fit_const(spark, d):
    e = NullEncoder(-1.0, null_column=False).fit(project(gaps(spark, d), ["q"]), "q").null
    return state(spark, [(e.nulls, e.value, e.has_indicator)], "nulls boolean, fill double, indicator boolean")


@query("null_transform", f"""
SELECT {IDS}, {sql_r('coalesce(q, (SELECT avg(q) FROM ' + GAPS + '))')} AS filled, (q IS NULL)::INTEGER::DOUBLE AS is_null
FROM {GAPS}""")
def null_transform(spark, d):
    df = project(gaps(spark, d), [*ID, "q"])
    out = NullEncoder("mean").fit_transform(df, "q")
    return out.select(*ID, r(F.col("q__value")).alias("filled"), F.col("q__is_null").alias("is_null"))


@query("null_reverse", f"SELECT {IDS}, q FROM {GAPS}")
def null_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "q"])
    e = NullEncoder("mean").fit(df, "q")
    return e.reverse_transform(e.transform(df, "q"), "q").select(*ID, "q")


# without an indicator, values equal to the fill become null as well
@query("null_reverse_fill", f"SELECT {IDS}, nullif(q, 10) AS q FROM {GAPS}")
def null_reverse_fill(spark, d):
    df = project(gaps(spark, d), [*ID, "q"])
    e = NullEncoder(10.0, null_column=False).fit(df, "q")
    return e.reverse_transform(e.transform(df, "q"), "q").select(*ID, "q")


# --- numbers ---------------------------------------------------------------

@query("num_transform", f"""
SELECT {IDS}, {sql_r('coalesce(n::DOUBLE, (SELECT avg(n) FROM ' + GAPS + '))')} AS value,
       (n IS NULL)::INTEGER::DOUBLE AS is_null FROM {GAPS}""")
def num_transform(spark, d):
    out = NumericEncoder().fit_transform(project(gaps(spark, d), [*ID, "n"]), "n")
    return out.select(*ID, r(F.col("n__value")).alias("value"), F.col("n__is_null").alias("is_null"))


@query("num_reverse", f"SELECT {IDS}, CASE WHEN n IS NOT NULL THEN round_even(n * 1.3::DOUBLE + 0.25::DOUBLE, 0)::BIGINT END AS n FROM {GAPS}")
def num_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "n"])
    e = NumericEncoder().fit(df, "n")
    moved = e.transform(df, "n").withColumn("n__value", F.col("n__value") * 1.3 + 0.25)
    return e.reverse_transform(moved, "n").select(*ID, "n")


ROUNDED = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
           "hundreds": "l_quantity * 100", "thirds": "l_quantity / 3"}


def rounding_sql(name: str, x: str) -> str:
    same = lambda k: f"bool_and(({x}) = {sql_half_even(x, k)})"
    decimals = " ".join(f"WHEN {same(k)} THEN {k}" for k in range(15))
    tens = " ".join(f"WHEN floor(log10(max(abs({x})))) >= {k} AND {same(-k)} THEN {-k}" for k in range(6, 0, -1))
    return (f"SELECT '{name}' AS column_name, (CASE WHEN bool_or(({x}) % 1 <> 0) THEN CASE {decimals} END "
            f"ELSE CASE {tens} ELSE 0 END END)::INTEGER AS digits FROM lineitem")


@query("learn_rounding", " UNION ALL ".join(rounding_sql(n, x) for n, x in ROUNDED.items()))
def learn_rounding(spark, d):
    df = load(spark, d, "lineitem").select(*[F.expr(x).alias(n) for n, x in ROUNDED.items()])
    aggs = {n: rounding_aggs(F.col(n)) for n in ROUNDED}
    row = df.agg(*[a.alias(f"{n}_{k}") for n, group in aggs.items() for k, a in group.items()]).first()
    rows = [(n, rounding_digits({k: row[f"{n}_{k}"] for k in group})) for n, group in aggs.items()]
    return state(spark, rows, "column_name string, digits int")


STRETCHED = "price * 1.2::DOUBLE - 5000"


def stretched(spark, d, encoder):
    df = project(gaps(spark, d), [*ID, "price"])
    e = encoder.fit(df, "price")
    moved = e.transform(df, "price").withColumn("price__value", F.col("price__value") * 1.2 - 5000)
    return e.reverse_transform(moved, "price").select(*ID, r(F.col("price")).alias("price"))


LIMITS = f"(SELECT min(price) AS lo, max(price) AS hi FROM {GAPS}) AS limits"


@query("num_bounded", f"SELECT {IDS}, {sql_r(f'greatest(lo, least(hi, {STRETCHED}))')} AS price FROM {GAPS}, {LIMITS}")
def num_bounded(spark, d):
    return stretched(spark, d, BoundedEncoder())


@query("num_rounded", f"SELECT {IDS}, {sql_r(sql_half_even(STRETCHED, 2))} AS price FROM {GAPS}")
def num_rounded(spark, d):
    return stretched(spark, d, RoundedEncoder())


@query("num_rounded_bounded", f"""
SELECT {IDS}, {sql_r(sql_half_even(f'greatest(lo, least(hi, {STRETCHED}))', 2))} AS price FROM {GAPS}, {LIMITS}""")
def num_rounded_bounded(spark, d):
    return stretched(spark, d, RoundedBoundedEncoder())


# --- copula ----------------------------------------------------------------

def sql_poly(x: str, coefficients) -> str:
    first, *rest = coefficients
    out = f"({first}::DOUBLE)"
    for k in rest:
        out = f"({out} * {x} + {k}::DOUBLE)"
    return out


def sql_ppf(p: str) -> str:
    def ratio(x, num, den):
        return f"({sql_poly(x, num[::-1])} / {sql_poly(x, den[::-1])})"

    q = f"({p} - 0.5::DOUBLE)"
    depth = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {ratio(f'(0.180625::DOUBLE - {q} * {q})', M.PPF_CENTRE_NUMERATOR, M.PPF_CENTRE_DENOMINATOR)}"
    middle = ratio(f"({depth} - 1.6::DOUBLE)", M.PPF_MIDDLE_NUMERATOR, M.PPF_MIDDLE_DENOMINATOR)
    tail = ratio(f"({depth} - 5)", M.PPF_TAIL_NUMERATOR, M.PPF_TAIL_DENOMINATOR)
    outer = f"(CASE WHEN {depth} <= 5 THEN {middle} ELSE {tail} END)"
    return f"(CASE WHEN abs({q}) <= 0.425::DOUBLE THEN {centre} WHEN {q} < 0 THEN -{outer} ELSE {outer} END)"


def sql_phi(z: str) -> str:
    a = f"abs({z})"
    near = f"exp(-{a} * {a} / 2) * {sql_poly(a, PHI_NUMERATOR)} / {sql_poly(a, PHI_DENOMINATOR)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {SQRT_TWO_PI}::DOUBLE"
    tail = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {PHI_SWITCH} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


@query("copula_transform", f"""
SELECT {IDS}, {sql_r(f'greatest({EPSILON}::DOUBLE, least(1 - {EPSILON}::DOUBLE, {sql_phi("z")}))')} AS u, is_null
FROM (SELECT {IDS}, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z, is_null
      FROM (SELECT {IDS}, coalesce(q, avg(q) OVER ()) AS x, (q IS NULL)::INTEGER::DOUBLE AS is_null FROM {GAPS}))""")
def copula_transform(spark, d):
    df = project(gaps(spark, d), [*ID, "q"])
    out = copula.CopulaEncoder(distribution="gaussian").fit_transform(df, "q")
    out = with_normal_cdf(out, {"u": "q__value"})
    return out.select(*ID, r(F.col("u")).alias("u"), F.col("q__is_null").alias("is_null"))


@query("copula_reverse", f"SELECT {IDS}, round(q, 4) AS q FROM {GAPS}")
def copula_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "q"])
    e = copula.CopulaEncoder(distribution="gaussian").fit(df, "q")
    back = e.reverse_transform(e.transform(df, "q"), "q")
    return back.select(*ID, F.round("q", 4).alias("q"))


FIT_COLUMNS = ["l_quantity", "l_extendedprice"]

# parameter formulas over the moments m, v, k, lo, hi, n of a column
FAMILY_SQL = {
    "gaussian": {"mean": "m", "std": "sqrt(v)"},
    "gamma": {"shape": "(m - lo) * (m - lo) / v", "loc": "lo", "scale": "v / (m - lo)"},
    "beta": {
        "a": "((m - lo) / (hi - lo)) * (((m - lo) / (hi - lo)) * (1 - (m - lo) / (hi - lo)) / (v / ((hi - lo) * (hi - lo))) - 1)",
        "b": "(1 - (m - lo) / (hi - lo)) * (((m - lo) / (hi - lo)) * (1 - (m - lo) / (hi - lo)) / (v / ((hi - lo) * (hi - lo))) - 1)",
        "loc": "lo", "scale": "hi - lo"},
    "student_t": {"dof": "CASE WHEN k > 0.06 THEN 4 + 6 / k ELSE 100.0::DOUBLE END", "loc": "m",
                  "scale": "sqrt(v * ((CASE WHEN k > 0.06 THEN 4 + 6 / k ELSE 100.0::DOUBLE END) - 2)"
                           " / (CASE WHEN k > 0.06 THEN 4 + 6 / k ELSE 100.0::DOUBLE END))"},
    "gaussian_kde": {"bandwidth": "sqrt(v) * pow(n::DOUBLE, -0.2::DOUBLE)"},
    "truncated_gaussian": {"mean": "m", "std": "sqrt(v)", "min": "lo", "max": "hi"},
}


def family_sql(family: str) -> str:
    moments = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS m, var_pop({c}) AS v, kurtosis_pop({c}) AS k, min({c}) AS lo, "
        f"max({c}) AS hi, count({c}) AS n FROM lineitem" for c in FIT_COLUMNS)
    return " UNION ALL ".join(
        f"SELECT column_name, '{p}' AS parameter, {sql_r(x, 5)} AS value FROM ({moments})"
        for p, x in FAMILY_SQL[family].items())


def marginal_fit(family: str):
    def run(spark, d):
        moments = copula.marginal_moments(load(spark, d, "lineitem"), FIT_COLUMNS).collect()
        rows = [(m["column_name"], p, float(v)) for m in moments
                for p, v in copula.family_parameters(family, m.asDict()).items()]
        out = state(spark, rows, "column_name string, parameter string, value double")
        return out.withColumn("value", r(F.col("value"), 5))
    return run


for _family in copula.FAMILIES:
    query(f"marginal_fit_{_family}", family_sql(_family))(marginal_fit(_family))


@query("marginal_select")
def marginal_select(spark, d):
    df = load(spark, d, "lineitem")
    encoders = {c: copula.CopulaEncoder(distribution="univariate") for c in FIT_COLUMNS}
    fit_all(df, encoders)
    rows = [(c, f, float(x), f == e.family) for c, e in encoders.items() for f, x in e.distances.items()]
    return state(spark, rows, "column_name string, family string, distance double, selected boolean")


# --- mixture ---------------------------------------------------------------

MIXTURE = [(0.5, 20000.0, 9000.0), (0.3, 55000.0, 12000.0), (0.004, 70000.0, 100.0), (0.196, 85000.0, 7000.0)]
VALID = [p for p in MIXTURE if p[0] > 0.005]


@query("bgmm_fit")
def bgmm_fit(spark, d):
    df = load(spark, d, "lineitem")
    return fit_mixtures(df, {c: F.col(c) for c in ["l_quantity", "l_extendedprice", "l_discount"]})


DENSITIES = [f"{w}::DOUBLE / {s}::DOUBLE * exp(-(price - {m}) * (price - {m}) / (2 * {s}::DOUBLE * {s}::DOUBLE))" for w, m, s in MIXTURE]
KEPT = [i for i, p in enumerate(MIXTURE) if p in VALID]
LIKELIEST = "CASE " + " ".join(f"WHEN p{i} = greatest({', '.join(f'p{k}' for k in KEPT)}) THEN {n}" for n, i in enumerate(KEPT)) + " END"


def drawn_sql(u: str) -> str:
    """How many of the kept components' running sums, floor included, stay below the draw."""
    total = " + ".join(f"p{i}" for i in range(len(MIXTURE)))
    chances = [f"(p{i} / ({total}) + {PROBABILITY_FLOOR!r}::DOUBLE)" for i in KEPT]
    below = [f"({' + '.join(chances[:n + 1])} < {u} * ({' + '.join(chances)}))::INTEGER" for n in range(len(KEPT) - 1)]
    return " + ".join(below)


def mixture_sql(component: str) -> str:
    means = ", ".join(f"{m}::DOUBLE" for _, m, _ in VALID)
    stds = ", ".join(f"{s}::DOUBLE" for *_, s in VALID)
    return f"""
SELECT {IDS}, component, {sql_r(f'greatest(-0.99::DOUBLE, least(0.99::DOUBLE, (price - [{means}][component + 1]) / (4 * [{stds}][component + 1])))', 9)} AS normalized
FROM (SELECT {IDS}, price, ({component})::INTEGER AS component
      FROM (SELECT {IDS}, price, {', '.join(f'{x} AS p{i}' for i, x in enumerate(DENSITIES))} FROM {GAPS}))"""


DRAW = "l_orderkey * 7 + l_linenumber"


def mixture(spark, d, **options):
    df = project(gaps(spark, d), [*ID, "price"])
    e = MixtureEncoder(**options).with_parameters(MIXTURE).fit(df, "price")
    return e.transform(df, "price").select(
        *ID, F.col("price__component").alias("component"), r(F.col("price__normalized"), 9).alias("normalized"))


@query("bgmm_transform_argmax", mixture_sql(LIKELIEST))
def bgmm_transform_argmax(spark, d):
    return mixture(spark, d, selection="argmax")


@query("bgmm_transform_sample", mixture_sql(drawn_sql(sql_u(DRAW, 7))))
def bgmm_transform_sample(spark, d):
    return mixture(spark, d, selection="sample", u=given_u(F.expr(DRAW), 7))


@query("bgmm_reverse", f"""
SELECT {IDS}, {sql_r('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (l_linenumber - 4) / 2.5::DOUBLE))'
                     ' * 4 * [' + ', '.join(f'{s}::DOUBLE' for *_, s in VALID) + '][l_linenumber % 3 + 1]'
                     ' + [' + ', '.join(f'{m}::DOUBLE' for _, m, _ in VALID) + '][l_linenumber % 3 + 1]')} AS price FROM {GAPS}""")
def bgmm_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "price"])
    e = MixtureEncoder().with_parameters(MIXTURE).fit(df, "price")
    encoded = df.select(*ID, ((F.col("l_linenumber") - 4) / 2.5).alias("price__normalized"),
                        F.pmod("l_linenumber", F.lit(3)).alias("price__component"))
    return e.reverse_transform(encoded, "price").select(*ID, r(F.col("price")).alias("price"))


# --- categories ------------------------------------------------------------

INTERVALS = f"""(SELECT value, n, (cum - n)::DOUBLE / total AS "start", cum::DOUBLE / total AS "end",
   (2 * cum - n)::DOUBLE / (2 * total) AS mid, n::DOUBLE / total / 6 AS std
 FROM (SELECT s AS value, count(*) AS n, sum(count(*)) OVER () AS total,
              sum(count(*)) OVER (ORDER BY count(*) DESC, s NULLS LAST ROWS UNBOUNDED PRECEDING) AS cum
       FROM {GAPS} GROUP BY s))"""


def fitted_category(spark, d, **options):
    df = project(gaps(spark, d), [*ID, "s"])
    return df, C.CategoricalEncoder(**options).fit(df, "s")


@query("cat_intervals", f"""
SELECT value, n, {sql_r('"start"', 9)} AS start_at, {sql_r('"end"', 9)} AS end_at, {sql_r('mid', 9)} AS mid, {sql_r('std', 9)} AS std
FROM {INTERVALS}""")
def cat_intervals(spark, d):
    _, e = fitted_category(spark, d)
    return e.cats.table.select("value", "n", r(F.col("start"), 9).alias("start_at"), r(F.col("end"), 9).alias("end_at"),
                               r(F.col("mid"), 9).alias("mid"), r(F.col("std"), 9).alias("std"))


@query("cat_transform", f"SELECT {IDS}, {sql_r('mid', 9)} AS value FROM {GAPS} g JOIN {INTERVALS} i ON g.s IS NOT DISTINCT FROM i.value")
def cat_transform(spark, d):
    df, e = fitted_category(spark, d)
    return e.transform(df, "s").select(*ID, r(F.col("s__value"), 9).alias("value"))


@query("cat_transform_fuzzy", f"""
SELECT {IDS}, {sql_r(f"mid + std * {sql_ppf('u')}", 9)} AS value
FROM (SELECT *, {sql_u(DRAW, 11)} AS u FROM {GAPS}) g JOIN {INTERVALS} i ON g.s IS NOT DISTINCT FROM i.value""")
def cat_transform_fuzzy(spark, d):
    df, e = fitted_category(spark, d, fuzzy=True, u=given_u(F.expr(DRAW), 11))
    return e.transform(df, "s").select(*ID, r(F.col("s__value"), 9).alias("value"))


OUTSIDE = "price / 40000 - 0.5::DOUBLE"


@query("cat_normalize_clip", f"SELECT {IDS}, {sql_r(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {OUTSIDE}))', 9)} AS value FROM {GAPS}")
def cat_normalize_clip(spark, d):
    x = C.CategoricalEncoder(clip_values=True).normalise(F.col("price") / 40000 - 0.5)
    return gaps(spark, d).select(*ID, r(x, 9).alias("value"))


@query("cat_normalize_mod", f"SELECT {IDS}, {sql_r(f'({OUTSIDE}) - floor({OUTSIDE})', 9)} AS value FROM {GAPS}")
def cat_normalize_mod(spark, d):
    x = C.CategoricalEncoder().normalise(F.col("price") / 40000 - 0.5)
    return gaps(spark, d).select(*ID, r(x, 9).alias("value"))


DRAW_KEY = "l_orderkey * 7 + l_linenumber + l_partkey * 13"


def drawn_values(spark, d):
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey") * 13
    return gaps(spark, d).select(*ID, given_u(key, 9).alias("s__value"))


@query("cat_reverse_nearest", f"""
WITH i AS MATERIALIZED (SELECT * FROM {INTERVALS}), x AS (SELECT {IDS}, {sql_u(DRAW_KEY, 9)} AS v FROM {GAPS})
SELECT {IDS}, struct_extract(min({{'gap': abs(v - mid), 'place': mid, 'value': value}}), 'value') AS s
FROM (SELECT {IDS}, v, row_number() OVER () AS rid FROM x), i GROUP BY {IDS}, v, rid""")
def cat_reverse_nearest(spark, d):
    _, e = fitted_category(spark, d)
    return e.reverse_transform(drawn_values(spark, d), "s").select(*ID, "s")


@query("cat_reverse_interval", f"""
WITH i AS MATERIALIZED (SELECT * FROM {INTERVALS}), x AS (SELECT {IDS}, {sql_u(DRAW_KEY, 9)} AS v FROM {GAPS})
SELECT {IDS}, i.value AS s FROM x ASOF JOIN i ON x.v >= i."start" """)
def cat_reverse_interval(spark, d):
    _, e = fitted_category(spark, d, lookup_by="interval")
    return e.reverse_transform(drawn_values(spark, d), "s").select(*ID, "s")


@query("onehot_fit", f"""
SELECT value, (row_number() OVER (ORDER BY value NULLS LAST) - 1)::INTEGER AS place FROM (SELECT DISTINCT f AS value FROM {GAPS})""")
def onehot_fit(spark, d):
    e = C.OneHotEncoder().fit(project(gaps(spark, d), ["f"]), "f")
    values = [*e.categories, *([None] if e.has_null else [])]
    return state(spark, [(v, i) for i, v in enumerate(values)], "value string, place int")


@query("onehot_transform", f"""
SELECT {IDS}, (f IS NOT DISTINCT FROM 'A')::INTEGER AS f__value0, (f IS NOT DISTINCT FROM 'N')::INTEGER AS f__value1,
       (f IS NULL)::INTEGER AS f__value2 FROM {GAPS}""")
def onehot_transform(spark, d):
    return C.OneHotEncoder().fit_transform(project(gaps(spark, d), [*ID, "f"]), "f")


@query("onehot_unknown", f"""
SELECT s AS value, count(*) AS n FROM {GAPS} WHERE s IS NOT NULL AND s NOT IN
 (SELECT s FROM {GAPS} WHERE s IS NOT NULL AND l_quantity = 50 AND disc = 0.1 AND f = 'N') GROUP BY s""")
def onehot_unknown(spark, d):
    df = gaps(spark, d)
    known = df.where((F.col("l_quantity") == 50) & (F.col("disc") == 0.1) & (F.col("f") == "N"))
    known = known.where(F.col("s").isNotNull()).select(F.col("s").alias("value")).distinct()
    return C.unknown_categories(df, "s", known)


@query("onehot_reverse", f"""
SELECT {IDS}, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'N' END AS f
FROM (SELECT {IDS}, {sql_u(DRAW_KEY, 1)} AS a, {sql_u(DRAW_KEY, 2)} AS b, {sql_u(DRAW_KEY, 3)} AS c FROM {GAPS})""")
def onehot_reverse(spark, d):
    df = gaps(spark, d)
    e = C.OneHotEncoder().fit(project(df, ["f"]), "f")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey") * 13
    scores = df.select(*ID, *[given_u(key, i + 1).alias(f"f__value{i}") for i in range(3)])
    return e.reverse_transform(scores, "f")


CODES = """(SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY user_id)"""


def fitted_label(spark, d):
    df = load(spark, d, "events").select("event_id", "user_id")
    return df, C.LabelEncoder(order="event_id").fit(df, "user_id")


@query("label_encode", f"SELECT event_id, code FROM events JOIN {CODES} USING (user_id)")
def label_encode(spark, d):
    df, e = fitted_label(spark, d)
    return e.transform(df, "user_id").select("event_id", F.col("user_id__value").alias("code"))


@query("label_decode", f"""
SELECT event_id, c.user_id FROM (SELECT event_id, round_even(greatest(0::DOUBLE, least((SELECT max(code) FROM {CODES})::DOUBLE,
   {sql_u('event_id', 4)} * 200::DOUBLE - 20::DOUBLE)), 0) AS code FROM events) x JOIN {CODES} c ON x.code = c.code""")
def label_decode(spark, d):
    df, e = fitted_label(spark, d)
    coded = df.select("event_id", (given_u("event_id", 4) * 200.0 - 20.0).alias("user_id__value"))
    return e.reverse_transform(coded, "user_id")


# --- booleans, datetimes, scaling ------------------------------------------

@query("bool_transform", f"""
SELECT {IDS}, coalesce(b::INTEGER::DOUBLE, -1) AS value, (b IS NULL)::INTEGER::DOUBLE AS is_null FROM {GAPS}""")
def bool_transform(spark, d):
    out = BooleanEncoder().fit_transform(project(gaps(spark, d), [*ID, "b"]), "b")
    return out.select(*ID, F.col("b__value").alias("value"), F.col("b__is_null").alias("is_null"))


@query("bool_reverse", f"""
SELECT {IDS}, CASE WHEN b IS NOT NULL THEN greatest(0, least(1, round_even(b::INTEGER::DOUBLE * 1.4 - 0.2 + disc * 3, 0)))::INTEGER::BOOLEAN END AS b
FROM {GAPS}""")
def bool_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "b", "disc"])
    e = BooleanEncoder().fit(df, "b")
    moved = e.transform(df, "b").withColumn("b__value", F.col("b__value") * 1.4 - 0.2 + F.col("disc") * 3)
    return e.reverse_transform(moved, "b").select(*ID, "b")


@query("dt_transform", f"""
SELECT {IDS}, {sql_r('coalesce(epoch_us(ts)::DOUBLE, (SELECT avg(epoch_us(ts)) FROM ' + GAPS + ')) / 1e9', 3)} AS value,
       (ts IS NULL)::INTEGER::DOUBLE AS is_null FROM {GAPS}""")
def dt_transform(spark, d):
    out = DatetimeEncoder().fit_transform(project(gaps(spark, d), [*ID, "ts"]), "ts")
    return out.select(*ID, r(F.col("ts__value") / 1e9, 3).alias("value"), F.col("ts__is_null").alias("is_null"))


@query("dt_reverse", f"SELECT {IDS}, ts FROM {GAPS}")
def dt_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "ts"])
    e = DatetimeEncoder().fit(df, "ts")
    return e.reverse_transform(e.transform(df, "ts"), "ts").select(*ID, "ts")


def divider_sql(name: str, x: str, table: str) -> str:
    units = divider_candidates()
    # the ladder stops at the first unit that does not divide all values
    steps = " ".join(f"WHEN NOT bool_and(epoch_us({x}) % {u} = 0) THEN {p}" for p, u in zip(units, units[1:]))
    return f"SELECT '{name}' AS column_name, (CASE {steps} ELSE {units[-1]} END)::BIGINT AS divider FROM {table}"


@query("dt_divider", " UNION ALL ".join([
    divider_sql("l_shipdate", "l_shipdate", "lineitem"), divider_sql("o_orderdate", "o_orderdate", "orders"),
    divider_sql("minutes", "date_trunc('minute', ts)", "events"), divider_sql("ts", "ts", "events")]))
def dt_divider(spark, d):
    rows = []
    events = load(spark, d, "events").select("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minutes"))
    for df, names in ((load(spark, d, "lineitem"), ["l_shipdate"]), (load(spark, d, "orders"), ["o_orderdate"]),
                      (events, ["minutes", "ts"])):
        fitted = fit_all(df, {n: DatetimeEncoder(strip_constant=True) for n in names})
        rows += [(n, e.divider) for n, e in fitted.items()]
    return state(spark, rows, "column_name string, divider bigint")


@query("dt_strip_transform", f"""
SELECT {IDS}, {sql_r('coalesce((epoch_us(ts) // 86400000000)::DOUBLE, (SELECT avg(epoch_us(ts) / 86400000000) FROM ' + GAPS + '))', 5)} AS value
FROM {GAPS}""")
def dt_strip_transform(spark, d):
    out = DatetimeEncoder(strip_constant=True).fit_transform(project(gaps(spark, d), [*ID, "ts"]), "ts")
    return out.select(*ID, r(F.col("ts__value"), 5).alias("value"))


@query("dt_strip_reverse", f"SELECT {IDS}, ts + INTERVAL 2 DAY AS ts FROM {GAPS}")
def dt_strip_reverse(spark, d):
    df = project(gaps(spark, d), [*ID, "ts"])
    e = DatetimeEncoder(strip_constant=True).fit(df, "ts")
    moved = e.transform(df, "ts").withColumn("ts__value", F.col("ts__value") + 2.25)
    return e.reverse_transform(moved, "ts").select(*ID, "ts")


SCALED = ["l_quantity", "price", "disc"]


@query("standard_scale", f"SELECT {IDS}, " + ", ".join(
    sql_r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in SCALED) + f" FROM {GAPS}")
def standard_scale(spark, d):
    df = project(gaps(spark, d), [*ID, *SCALED])
    encoders = fit_all(df, {c: StandardEncoder() for c in SCALED})
    for c, e in encoders.items():
        df = e.transform(df, c)
    return df.select(*ID, *[r(F.col(f"{c}__value")).alias(c) for c in SCALED])


@query("standard_unscale", f"SELECT {IDS}, " + ", ".join(f"{sql_r(c)} AS {c}" for c in SCALED) + f" FROM {GAPS}")
def standard_unscale(spark, d):
    df = project(gaps(spark, d), [*ID, *SCALED])
    encoders = fit_all(df, {c: StandardEncoder() for c in SCALED})
    for c, e in encoders.items():
        df = e.transform(df, c)
    for c, e in encoders.items():
        df = e.reverse_transform(df, c)
    return df.select(*ID, *[r(F.col(c)).alias(c) for c in SCALED])


@query("identity_transform", f"SELECT {IDS}, price AS price__value FROM {GAPS}")
def identity_transform(spark, d):
    return IdentityEncoder().fit_transform(project(gaps(spark, d), [*ID, "price"]), "price")
