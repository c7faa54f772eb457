"""Queries against their SQL: a few per module, all of them with TABLOOM_ALL=1."""

import os

import duckdb
import pytest

from tabloom.catalog import load_all

QUERIES, ORACLES = load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SOME = """rule_report category_widths natural_join_fanout group_head tiered_cap_medium shift_stay_times cohort_small
cohort_medium null_reverse_fill num_rounded_bounded learn_rounding copula_transform bgmm_transform_argmax cat_intervals
cat_reverse_nearest cat_reverse_interval onehot_reverse label_decode dt_strip_reverse table_transform table_roundtrip
encode_survival_standard chisq_stat ks_extended kl_continuous kl_discrete gower_mean corr_rmse hist_compare_num
rdp_integer rdp_fractional eps_spent clipped_sum thresh_otsu thresh_momentum clip_report pareto_front stat_thin_avg
early_stop_epoch gen_random_mixed_nans gen_normal categorical_draw scan_csv_gz sink_cohort stream_encode stream_thin""".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    cells = [tuple(None if v is None or v != v else str(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names])]
    return names, sorted(cells, key=lambda r: tuple((v is None, v or "") for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TABLOOM_ALL") else SOME)
def test_matches_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data).toArrow()
    want = duck.execute(ORACLES[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
