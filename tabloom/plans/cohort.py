"""Cohort building: five related tables to one flat table, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import col, keyed_uniform
from tabloom.functions.skew import hot_keys, skew_join
from tabloom.operators import dates
from tabloom.operators.dedup import group_head, keep_first, tiered_cap
from tabloom.operators.joins import lookup_join

SUBJECT, STAY = "SUBJECT_ID", "ICUSTAY_ID"
CHART_COLUMNS = [SUBJECT, STAY, "CHARTTIME", "ITEMID", "VALUE", "VALUEUOM"]


@dataclass(frozen=True)
class CohortTables:
    """The source tables, under the column names the job uses.

    ``admission_key`` and ``chart_key`` name unique row keys that fix row order.
    """

    admissions: DataFrame
    patients: DataFrame
    stays: DataFrame
    charts: DataFrame
    items: DataFrame
    admission_key: str = "admission_key"
    chart_key: str = "chart_key"


@dataclass(frozen=True)
class Draws:
    """Uniform columns for the random shifts; the default hashes the row keys."""

    birth: Column
    admit: Column
    stay: Column
    chart: Column

    @staticmethod
    def keyed(t: CohortTables, seed: int) -> "Draws":
        row = [t.admission_key, STAY, t.chart_key]
        return Draws(keyed_uniform([SUBJECT], seed), keyed_uniform(row, seed + 1),
                     keyed_uniform(row, seed + 2), keyed_uniform(row, seed + 3))


def chronology(admit: str = "ADMITTIME", chart: str = "CHARTTIME", discharge: str = "DISCHTIME") -> Column:
    """Charted strictly inside the stay."""
    return (col(admit) < col(chart)) & (col(discharge) > col(chart))


def build_cohort(t: CohortTables, size: str = "small", draws: Draws | None = None, seed: int = 2021) -> DataFrame:
    """The small, medium or large cohort.

    Small keeps one chart row per stay and four rows per patient; medium and
    large cap chart rows per patient by tier (30/60/10 and 30/40/30 % of the
    patients get 1, 2 and 100). The chart table is reduced before any join,
    and patients holding a large share of rows are spread over salts.
    """
    draws = draws or Draws.keyed(t, seed)
    if size == "small":
        charts = keep_first(t.charts, [SUBJECT, STAY], [t.chart_key])
    elif size in ("medium", "large"):
        shares = [0.3, 0.9] if size == "medium" else [0.3, 0.7]
        charts = tiered_cap(t.charts, SUBJECT, t.chart_key, shares, [1, 2, 100])
    else:
        raise ValueError("size must be small, medium or large")

    # Every admission meets every charted stay of its patient (fan-out by
    # patient); joining charts to stays first keeps the fanned-out side small.
    patients = dates.rebase_birth_date(t.patients, "DOB", draws.birth)
    charted = t.stays.join(charts.select(*CHART_COLUMNS, t.chart_key), [SUBJECT, STAY])
    often = hot_keys(t.admissions, [SUBJECT])
    admissions = skew_join(t.admissions, patients, [SUBJECT], often, hot_right=[])  # a patient has one row
    admitted = dates.with_shift_ranges(admissions, "DOB", "ADMITTIME", "DISCHTIME")
    fanned = skew_join(charted, admitted, [SUBJECT], hot_keys(t.stays, [SUBJECT]), hot_right=often)
    moved = dates.draw_stay_times(fanned, "DOB", "ADMITTIME", "DISCHTIME", "CHARTTIME",
                                  draws.admit, draws.stay, draws.chart)
    labelled = lookup_join(moved.where(chronology()), t.items, ["ITEMID"])
    cohort = labelled.withColumn("age", dates.age_years(col("DOB"), dates.ntz(dates.REFERENCE_DATE)))
    if size == "small":
        cohort = group_head(cohort, [SUBJECT], [t.admission_key, STAY, t.chart_key], 4)
    return cohort.drop(STAY, "ITEMID", t.admission_key, t.chart_key)
