"""Encoders of fields made of several columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalar import col
from tabloom.operators.encoder import FieldEncoder, append, register


@register("joint")
class JointEncoder(FieldEncoder):
    """Columns of categories to one category, their combination, so that what occurs together stays together.

    The output is text, to be encoded further; null is a value of its own in
    each column.
    """

    input_type = "categorical"
    output_types = {"value": "categorical"}

    def finish(self, stats, dtypes):
        self.dtypes = dtypes

    def encode(self, df, columns, prefix):
        parts = F.struct(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
        return append(df, F.to_json(parts, {"ignoreNullFields": "false"}), f"{prefix}__value")

    def decode(self, df, prefix, columns):
        schema = ", ".join(f"c{i} string" for i in range(len(columns)))
        parsed = df.withColumn("_parts", F.from_json(col(f"{prefix}__value"), schema))
        made = {c: F.col("_parts")[f"c{i}"].cast(t) for i, (c, t) in enumerate(zip(columns, self.dtypes))}
        return parsed.withColumns(made).drop("_parts")


@register("date_parts")
class DatePartsEncoder(FieldEncoder):
    """Columns of year, month and day to one datetime.

    A row whose parts make no date has no datetime, and null parts after reverse.
    """

    input_type = "numerical"
    output_types = {"value": "datetime"}

    def finish(self, stats, dtypes):
        if len(dtypes) != 3:
            raise ValueError("a date needs the columns of year, month and day")
        self.dtypes = dtypes

    def encode(self, df, columns, prefix):
        y, m, d = (F.lpad(col(c).cast("int").cast("string"), n, "0") for c, n in zip(columns, (4, 2, 2)))
        return append(df, F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("timestamp_ntz"), f"{prefix}__value")

    def decode(self, df, prefix, columns):
        stamp = col(f"{prefix}__value")
        return df.withColumns({c: part(stamp).cast(t) for c, t, part in zip(columns, self.dtypes, (F.year, F.month, F.dayofmonth))})
