"""Categorical encoders: frequency intervals, one-hot and integer labels.

Fitted state of up to ``LITERAL_LIMIT`` categories lives in literals and small
broadcast tables. Larger sets stay distributed tables that are joined, with the
most frequent values handled by literals so that no join key is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.order import add_bucket, ordered_blocks, running_totals
from tabloom.functions.scalar import clip, col, floor_mod_one, keyed_uniform, literal_array, lookup, with_normal_ppf
from tabloom.functions.skew import skew_join
from tabloom.operators.encoder import ColumnEncoder, append, register

CASE_LIMIT = 32           # categories spelled out as CASE branches
LITERAL_LIMIT = 5_000     # categories kept on the driver and in literals
WINDOW_LIMIT = 100_000    # categories ordered inside one task
CELLS = 1 << 20           # cells of [0, 1] for the distributed interval search
ONEHOT_LIMIT = 1_000      # categories with a column each; more share one sparse column
SPARSE = "array<struct<i: int, v: double>>"


def interval_table(counts: DataFrame, total: int, size: int) -> DataFrame:
    """(value, n) to (value, n, start, end, mid, std) by descending frequency.

    Ties are ordered by value, a null category last among its ties.
    """
    order = [F.desc("n"), F.asc_nulls_last("value")]
    if size <= WINDOW_LIMIT:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        summed = counts.withColumn("cum_n", F.sum("n").over(w))
    else:
        summed = running_totals(ordered_blocks(counts, order).withColumn("g", F.lit(0)), ["g"], "blk", order, ["n"])
    t = F.lit(float(total))
    return summed.select(
        "value", "n",
        ((F.col("cum_n") - F.col("n")) / t).alias("start"),
        (F.col("cum_n") / t).alias("end"),
        ((2 * F.col("cum_n") - F.col("n")) / (2 * t)).alias("mid"),
        (F.col("n") / t / 6).alias("std"),
    )


def count_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Categories:
    """Fitted categories: collected rows when few, a distributed table always."""

    table: DataFrame
    size: int
    rows: list | None
    cells: dict[str, DataFrame] = field(default_factory=dict)  # of the interval search, by the way of looking up

    @property
    def small(self) -> bool:
        return self.rows is not None


def attach(df: DataFrame, column: str, cats: Categories, fields: list[str], names: list[str]) -> DataFrame:
    """Append fitted fields for the value of ``column`` (null is a category)."""
    key = col(column).cast("string")
    if cats.small and cats.size <= CASE_LIMIT:
        return df.select("*", *[
            lookup(key, {r["value"]: r[f] for r in cats.rows}).alias(n) for f, n in zip(fields, names)])
    renamed = cats.table.select(F.col("value").alias("_value"), *[F.col(f).alias(n) for f, n in zip(fields, names)])
    if cats.small:
        return df.join(F.broadcast(renamed), key.eqNullSafe(F.col("_value")), "left").drop("_value")
    hot = cats.table.orderBy(F.desc("n")).limit(CASE_LIMIT).collect() + cats.table.where("value is null").collect()
    frequent = [r["value"] for r in hot if r["value"] is not None]
    is_hot = key.isNull() | key.isin(frequent)
    by_case = df.where(is_hot).select("*", *[
        lookup(key, {r["value"]: r[f] for r in hot}).alias(n) for f, n in zip(fields, names)])
    by_join = df.where(~is_hot).join(renamed, key == F.col("_value"), "left").drop("_value")
    return by_case.unionByName(by_join)


@register("categorical")
class CategoricalEncoder(ColumnEncoder):
    """Each category becomes the midpoint of its frequency interval in [0, 1].

    ``fuzzy`` adds normal noise of a sixth of the interval, from a hash of
    ``keys`` when given (repeatable), from a given uniform ``u``, or from ``seed``. ``lookup`` picks the
    reverse: the nearest midpoint, or the last interval starting at or below.
    """

    input_type = "categorical"
    value_counts = True

    def __init__(self, fuzzy: bool = False, clip_values: bool = False, lookup_by: str = "nearest",
                 keys: list[str] | None = None, seed: int = 0, u: Column | None = None):
        if lookup_by not in ("nearest", "interval"):
            raise ValueError("lookup_by must be 'nearest' or 'interval'")
        self.fuzzy, self.clip_values, self.lookup_by = fuzzy, clip_values, lookup_by
        self.keys, self.seed, self.u = keys, seed, u
        self.transform_deterministic = not fuzzy

    def fit_aggs(self, c):
        return {"distinct": F.approx_count_distinct(c.cast("string")), "rows": F.count(F.lit(1))}

    def finish(self, stats, dtype):
        self.dtype, self.total, self.about = dtype, stats["rows"], stats["distinct"] + 1

    def extra_fit(self, df, column):
        counts = count_values(df, column) if self.counts is None else self.counts
        table = interval_table(counts, max(1, self.total), self.about)
        if self.about <= LITERAL_LIMIT:
            rows = sorted(table.collect(), key=lambda r: r["start"])
            fixed = df.sparkSession.createDataFrame(rows, table.schema) if rows else table
            self.cats = Categories(fixed, len(rows), rows)
        else:
            from tabloom.session import checkpoint
            table = checkpoint(table)
            self.cats = Categories(table, table.count(), None)

    def with_noise(self, df: DataFrame) -> DataFrame:
        if self.u is None and not self.keys:
            return df.withColumn("_noise", F.randn(self.seed))
        u = keyed_uniform(self.keys, self.seed) if self.u is None else self.u
        return with_normal_ppf(df, {"_noise": u})

    def encode(self, df, column, prefix):
        out = f"{prefix}__value"
        if not self.fuzzy:
            return attach(df, column, self.cats, ["mid"], [out])
        both = attach(df, column, self.cats, ["mid", "std"], [out, "_std"])
        return self.with_noise(both).withColumn(out, col(out) + F.col("_noise") * F.col("_std")).drop("_std", "_noise")

    def normalise(self, c: Column) -> Column:
        """Bring values into [0, 1] by clipping or by the remainder of 1."""
        return clip(c, 0.0, 1.0) if self.clip_values else floor_mod_one(c)

    def decode(self, df, prefix, column):
        x = df.withColumn("_x", self.normalise(col(f"{prefix}__value")))
        if self.cats.small:
            rows = self.cats.rows
            if self.lookup_by == "nearest":
                # a value exactly between two midpoints goes to the first, hence the next float
                cuts = [math.nextafter((a["mid"] + b["mid"]) / 2, math.inf) for a, b in zip(rows, rows[1:])]
            else:
                cuts = [r["start"] for r in rows[1:]]
            found = add_bucket(x, "_x", cuts, "_i")
            values = literal_array([r["value"] for r in rows], "string")
            return found.withColumn(column, F.get(values, F.col("_i")).cast(self.dtype)).drop("_x", "_i")
        return self._decode_by_join(x, column)

    def _cells(self) -> DataFrame:
        """(cell, value, lo, hi) of every interval in each cell of [0, 1] that it meets; written once, then read by every search."""
        from tabloom.session import checkpoint

        if self.lookup_by not in self.cats.cells:
            self.cats.cells[self.lookup_by] = checkpoint(self._make_cells())
        return self.cats.cells[self.lookup_by]

    def _cell(self, v: Column) -> Column:
        in_all = max(CELLS, self.cats.size)  # so that a cell meets few intervals, however many there are
        return clip(F.floor(v * in_all), 0, in_all - 1)

    def _make_cells(self) -> DataFrame:
        t = self.cats.table
        if self.lookup_by == "nearest":
            # neighbours in interval order share start and end
            a, b = t.select("value", "start", "end", "mid"), t.select(F.col("start").alias("end"), F.col("mid").alias("_next"))
            left = a.join(b, "end", "left")
            c = t.select(F.col("end").alias("start"), F.col("mid").alias("_before"))
            both = left.join(c, "start", "left")
            low, high = (F.col("_before") + F.col("mid")) / 2, (F.col("mid") + F.col("_next")) / 2
        else:
            both = t.select("value", "start", "end")
            low = F.when(F.col("start") > 0, F.col("start"))
            high = F.when(F.col("end") < 1, F.col("end"))
        bounds = both.select(
            F.col("value").alias("_value"), F.coalesce(low, F.lit(-1.0)).alias("_lo"), F.coalesce(high, F.lit(2.0)).alias("_hi"))
        return bounds.withColumn("_cell", F.explode(F.sequence(self._cell(F.col("_lo")), self._cell(F.col("_hi")))))

    def _decode_by_join(self, x: DataFrame, column: str) -> DataFrame:
        """Interval search as an equi-join on cells of [0, 1] plus a range check; the cells are fixed, so a stream can be searched."""
        cells = self._cells()
        above = F.col("_x") > F.col("_lo") if self.lookup_by == "nearest" else F.col("_x") >= F.col("_lo")
        inside = above & (F.col("_x") <= F.col("_hi") if self.lookup_by == "nearest" else F.col("_x") < F.col("_hi"))
        # rows without a number match no cell; they are spread over negative ones and stay with a null
        void = F.col("_x").isNull() | F.isnan("_x")
        rows = x.withColumn("_cell", F.when(void, spread_below_zero(x)).otherwise(self._cell(F.col("_x"))))
        joined = skew_join(rows, cells, ["_cell"], how="left").where(inside | void)
        return joined.withColumn(column, F.col("_value").cast(self.dtype)).drop("_x", "_cell", "_value", "_lo", "_hi")


@register("categorical_fuzzy")
class CategoricalFuzzyEncoder(CategoricalEncoder):
    def __init__(self, clip_values: bool = False, keys: list[str] | None = None, seed: int = 0):
        super().__init__(fuzzy=True, clip_values=clip_values, keys=keys, seed=seed)


@register("one_hot")
class OneHotEncoder(ColumnEncoder):
    """One 0/1 column per category, the null column last.

    Categories are ordered by first appearance along ``order`` or by value, or
    given as ``categories``. A column with more than ``limit`` of them gets one
    sparse output instead (see :class:`SparseOneHotEncoder`).
    """

    wide: SparseOneHotEncoder | None = None

    input_type = "categorical"

    def __init__(self, order: str | None = None, error_on_unknown: bool = False, limit: int = ONEHOT_LIMIT,
                 categories: list | None = None):
        self.order, self.error_on_unknown, self.limit = order, error_on_unknown, limit
        self.given = categories

    def fit_aggs(self, c):
        return {} if self.given is not None else {"nulls": F.count_if(c.isNull())}

    def finish(self, stats, dtype):
        self.has_null, self.dtype = stats.get("nulls", 0) > 0, dtype

    def extra_fit(self, df, column):
        if self.given is not None:  # known beforehand: nothing to read
            self.categories = list(self.given)
            return
        key = F.min(col(self.order)) if self.order else F.min(col(column))
        seen = (df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(key.alias("k"))
                .orderBy("k", "value").limit(self.limit + 1).collect())
        self.wide = None
        if len(seen) > self.limit:
            self.wide = SparseOneHotEncoder(self.order, self.error_on_unknown)
            self.wide.fit(df, column)
            return
        self.categories = [r["value"] for r in seen]

    @property
    def width(self) -> int:
        return self.wide.width if self.wide else len(self.categories) + self.has_null

    def get_output_types(self):
        if self.wide:
            return self.wide.get_output_types()
        return {f"value{i}": "float" for i in range(len(self.categories) + self.has_null)}

    def encode(self, df, column, prefix):
        if self.wide:
            return self.wide.encode(df, column, prefix)
        c = col(column)
        hits = [(c.eqNullSafe(F.lit(v))).cast("int") for v in self.categories]
        if self.has_null:
            hits.append(c.isNull().cast("int"))
        if self.error_on_unknown and hits:
            known = F.greatest(*hits) if len(hits) > 1 else hits[0]
            checked = F.when(known == 0, F.raise_error(F.lit(f"unknown category in {column}")).cast("int"))
            hits = [F.coalesce(checked, h) for h in hits]
        return df.select("*", *[h.alias(f"{prefix}__value{i}") for i, h in enumerate(hits)])

    def decode(self, df, prefix, column):
        if self.wide:
            return self.wide.decode(df, prefix, column)
        blocks = F.array(*[col(c).cast("double") for c in self.output_columns(prefix)])
        place = F.array_position(blocks, F.array_max(blocks)).cast("int")
        values = [F.lit(v).cast(self.dtype) for v in self.categories]
        if self.has_null:
            values.append(F.lit(None).cast(self.dtype))
        return append(df, F.get(F.array(*values), place - 1), column)


def spread_below_zero(df: DataFrame) -> Column:
    """A join key that no fitted code or cell has, spread by the row's content."""
    return F.lit(-1).cast("bigint") - F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(9973))


def unknown_categories(df: DataFrame, column: str, known: DataFrame, value: str = "value") -> DataFrame:
    """Distinct non-null values that the fitted categories do not hold, with counts."""
    found = df.where(col(column).isNotNull()).groupBy(col(column).alias(value)).agg(F.count(F.lit(1)).alias("n"))
    return found.join(known.select(value), value, "left_anti")


@register("label")
class LabelEncoder(ColumnEncoder):
    """Integer codes by first appearance along ``order`` (or by value).

    An unknown value encodes to null; decoding clips to the known range.
    """

    input_type = "categorical"
    output_types = {"value": "integer"}

    def __init__(self, order: str | None = None):
        self.order = order

    def fit_aggs(self, c):
        return {"distinct": F.approx_count_distinct(c.cast("string"))}

    def finish(self, stats, dtype):
        self.dtype, self.about = dtype, stats["distinct"] + 1

    def extra_fit(self, df, column):
        key = F.min(col(self.order)) if self.order else F.min(col(column))
        seen = df.groupBy(col(column).cast("string").alias("value")).agg(key.alias("k"), F.count(F.lit(1)).alias("n"))
        order = [F.asc_nulls_last("k"), F.asc_nulls_last("value")]
        if self.about <= WINDOW_LIMIT:
            table = seen.withColumn("code", F.row_number().over(Window.orderBy(*order)) - 1)
        else:
            blocks = ordered_blocks(seen, order).withColumns({"g": F.lit(0), "one": F.lit(1)})
            table = running_totals(blocks, ["g"], "blk", order, ["one"]).withColumn("code", F.col("cum_one") - 1)
        table = table.select("value", "n", F.col("code").cast("bigint").alias("code"))
        if self.about <= LITERAL_LIMIT:
            rows = sorted(table.collect(), key=lambda r: r["code"])
            fixed = df.sparkSession.createDataFrame(rows, table.schema) if rows else table
            self.cats = Categories(fixed, len(rows), rows)
        else:
            from tabloom.session import checkpoint
            table = checkpoint(table)
            self.cats = Categories(table, table.count(), None)

    def encode(self, df, column, prefix):
        return attach(df, column, self.cats, ["code"], [f"{prefix}__value"])

    def decode(self, df, prefix, column):
        code = F.rint(clip(col(f"{prefix}__value").cast("double"), 0.0, float(self.cats.size - 1))).cast("bigint")
        return self.named(df, code, column)

    def named(self, df: DataFrame, code: Column, column: str) -> DataFrame:
        """``column`` with the values of the codes; a null code is a null value."""
        if self.cats.small:
            values = literal_array([r["value"] for r in self.cats.rows], "string")
            return append(df, F.get(values, code.cast("int")).cast(self.dtype), column)
        coded = df.withColumn("code", F.coalesce(code, spread_below_zero(df)))  # a null code stays a null value
        table = self.cats.table.select("code", F.col("value").alias("_value"))
        joined = skew_join(coded, table, ["code"], how="left")
        return joined.withColumn(column, F.col("_value").cast(self.dtype)).drop("code", "_value")


@register("one_hot_sparse")
class SparseOneHotEncoder(LabelEncoder):
    """All categories in one output: the positions that are not zero, with their values.

    The dictionary of positions is a table, joined in both directions, so any
    number of categories fits; null is the last of them. An unknown value has no
    position. Reverse takes the position with the largest value, the first of
    equal ones; an output without positions means the first category, as a row
    of zeros does in the dense form.
    """

    output_types = {"value": "sparse"}

    def __init__(self, order: str | None = None, error_on_unknown: bool = False):
        super().__init__(order)
        self.error_on_unknown = error_on_unknown

    @property
    def width(self) -> int:
        return self.cats.size

    def encode(self, df, column, prefix):
        out = f"{prefix}__value"
        code = col(out)
        none = F.array().cast(SPARSE)
        if self.error_on_unknown:
            none = F.raise_error(F.lit(f"unknown category in {column}")).cast(SPARSE)
        one = F.array(F.struct(code.cast("int").alias("i"), F.lit(1.0).alias("v")))
        return super().encode(df, column, prefix).withColumn(out, F.when(code.isNull(), none).otherwise(one))

    def decode(self, df, prefix, column):
        out = col(f"{prefix}__value")
        best = F.array_max(F.transform(out, lambda x: F.struct(x["v"].alias("v"), (-x["i"]).alias("i"))))
        code = F.when(out.isNotNull(), F.coalesce(clip(-best["i"], 0, self.width - 1), F.lit(0)).cast("bigint"))
        return self.named(df, code, column)


def sparse_to_dense(value: Column, width: int) -> Column:
    """The array of all positions of a sparse output."""
    known = F.map_from_entries(value)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(known, i), F.lit(0.0)))


def dense_to_sparse(values: Column) -> Column:
    """The positions of an array that are not zero."""
    cells = F.transform(values, lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("double").alias("v")))
    return F.filter(cells, lambda c: c["v"] != 0)


def sparse_vectors(df: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """A sparse one-hot output as a sparse vector for ``pyspark.ml``, made in the JVM; all zeros where there is no position."""
    from pyspark.ml.feature import OneHotEncoder as Vectors

    # the category after the last one stands for none; without it the vector is empty there
    ends = df.sparkSession.range(width, width + 1).select(F.col("id").cast("double").alias("_at"))
    model = Vectors(inputCols=["_at"], outputCols=[out], dropLast=True).fit(ends)
    at = F.coalesce(F.get(col(value), 0)["i"], F.lit(width)).cast("double")
    return model.transform(df.withColumn("_at", at)).drop("_at")
