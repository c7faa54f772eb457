"""Date counting, parsing and random date shifting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import col, half_even, uniform_int

DAY_MICROS = 86_400_000_000
SECOND_MICROS = 1_000_000
YEAR_DAYS = 365.2425  # mean Gregorian year
REFERENCE_DATE = "2021-12-01 00:00:00"
OLD_BORDER = "1930-01-01 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.cast("bigint")).cast("timestamp_ntz")


def parse_datetime(c: Column | str, fmt: str, strict: bool = False) -> Column:
    """Parse text; strict raises on a bad value, otherwise it becomes null."""
    parsed = F.to_timestamp(col(c), fmt) if strict else F.try_to_timestamp(col(c), F.lit(fmt))
    return parsed.cast("timestamp_ntz")


def parse_report(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """Counts of parsed, rejected and missing values of a text column."""
    if dict(df.dtypes)[column] != "string":
        raise TypeError(f"column {column!r} is not text, so a datetime format does not apply")
    raw, parsed = col(column), parse_datetime(column, fmt)
    return df.agg(
        F.count_if(parsed.isNotNull()).alias("parsed"),
        F.count_if(raw.isNotNull() & parsed.isNull()).alias("rejected"),
        F.count_if(raw.isNull()).alias("missing"),
    )


def year_ends_between(start: Column, end: Column) -> Column:
    """Number of 31 December dates in [start, end] for midnight inputs, 0 if reversed."""
    reached = (F.month(end) == 12) & (F.dayofmonth(end) == 31)
    return F.greatest(F.lit(0), F.year(end) - F.year(start) + reached.cast("int"))


def _steps(start: Column, end: Column, unit: int) -> Column:
    gap = micros(end) - micros(start)
    return F.when(gap >= 0, F.floor(gap / F.lit(float(unit))) + 1).otherwise(F.lit(0)).cast("bigint")


def day_steps(start: Column, end: Column) -> Column:
    """Inclusive count of whole-day steps from start to end, 0 if reversed."""
    return _steps(start, end, DAY_MICROS)


def second_steps(start: Column, end: Column) -> Column:
    return _steps(start, end, SECOND_MICROS)


def add_years(c: Column, years: Column) -> Column:
    """Calendar shift that keeps the time of day; 29 February becomes the 28th."""
    return c + F.make_ym_interval(years.cast("int"), F.lit(0))


def add_days(c: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("bigint"), c)


def add_seconds(c: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("bigint"), c)


def rebase_birth_date(df: DataFrame, birth: str, u: Column, offset: str = "DOB_offset") -> DataFrame:
    """Move very old and future birth dates into a plausible range.

    Before 1930: forward by U[y-80, y-40) years, y the year ends up to the
    reference date. After it: back by U[y+30, y+50). Otherwise unchanged.
    """
    d, ref = col(birth), ntz(REFERENCE_DATE)
    behind, ahead = year_ends_between(d, ref), year_ends_between(ref, d)
    years = (
        F.when((behind != 0) & (d < ntz(OLD_BORDER)), uniform_int(u, behind - 80, behind - 40))
        .when((ahead != 0) & (d > ref), -uniform_int(u, ahead + 30, ahead + 50))
        .otherwise(F.lit(0)).cast("bigint")
    )
    shifted = df.withColumn(offset, years)
    return shifted.withColumn(birth, add_years(col(birth), col(offset)))


def with_shift_ranges(df: DataFrame, birth: str, admit: str, discharge: str) -> DataFrame:
    """Add the draw ranges of the stay times, which depend on the admission only.

    Computing them before a fan-out join keeps the date arithmetic off the
    fanned-out rows. d and s count the days from birth to the reference date
    and the seconds of stay; admit days are in [round(.25d), round(.9d)+5),
    chart seconds in [round(.01s)+1, round(.99s)+10).
    """
    d = day_steps(col(birth), ntz(REFERENCE_DATE))
    s = second_steps(col(admit), col(discharge))
    return df.withColumns({"_d": d, "_s": s}).withColumns({
        "_admit_lo": half_even(F.col("_d") * 0.25).cast("bigint"),
        "_admit_hi": half_even(F.col("_d") * 0.9).cast("bigint") + 5,
        "_chart_lo": half_even(F.col("_s") * 0.01).cast("bigint") + 1,
        "_chart_hi": half_even(F.col("_s") * 0.99).cast("bigint") + 10,
    }).drop("_d", "_s")


def draw_stay_times(df: DataFrame, birth: str, admit: str, discharge: str, chart: str,
                    u_admit: Column, u_stay: Column, u_chart: Column) -> DataFrame:
    """Replace the three stay times by draws from the ranges added before.

    admit = birth + days, discharge = admit + U[0, 50) days, chart = admit + seconds.
    """
    days = uniform_int(u_admit, F.col("_admit_lo"), F.col("_admit_hi"))
    seconds = uniform_int(u_chart, F.col("_chart_lo"), F.col("_chart_hi"))
    moved = df.withColumn(admit, add_days(col(birth), days))
    return moved.withColumns({
        discharge: add_days(col(admit), uniform_int(u_stay, F.lit(0), F.lit(50))),
        chart: add_seconds(col(admit), seconds),
    }).drop("_admit_lo", "_admit_hi", "_chart_lo", "_chart_hi")


def shift_stay_times(df: DataFrame, birth: str, admit: str, discharge: str, chart: str,
                     u_admit: Column, u_stay: Column, u_chart: Column) -> DataFrame:
    """Fresh admission, discharge and chart times, drawn from the birth date."""
    ranged = with_shift_ranges(df, birth, admit, discharge)
    return draw_stay_times(ranged, birth, admit, discharge, chart, u_admit, u_stay, u_chart)


def age_years(birth: Column, reference: Column) -> Column:
    """Whole mean-Gregorian years between birth and reference."""
    return F.floor((micros(reference) - micros(birth)) / F.lit(YEAR_DAYS * DAY_MICROS)).cast("int")
