"""Headline timings as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
``ceilings`` holds, where one applies, the reference's declared seconds per
row and column times the rows and columns processed here.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.catalog import load_all  # noqa: E402
from tabloom.operators.table import TableEncoder  # noqa: E402
from tabloom.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

QUERIES = [
    "cohort_small", "cohort_medium", "cohort_large", "tiered_cap_medium", "natural_join_fanout", "group_head",
    "encode_survival_standard", "cat_reverse_nearest", "bgmm_fit", "copula_transform", "ks_stat", "kl_continuous",
    "gower_mean", "corr_rmse", "chisq_stat", "clipped_sum", "eps_spent", "pareto_front", "stat_thin_avg",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main():
    queries, _ = load_all()
    spark = get_session("bench", CPUS, CPUS, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rows, columns = lines.count(), len(lines.columns)
    run(lines.select("l_quantity"))  # starts the session's threads
    times: dict[str, float] = {}

    def timed(name, job):
        start = time.time()
        out = job()
        times[name] = round(time.time() - start, 3)
        return out

    encoder = timed("table_fit_all", lambda: TableEncoder().fit(lines))
    timed("table_transform_all", lambda: run(encoder.transform(lines)))
    timed("table_reverse_all", lambda: run(encoder.reverse_transform(encoder.transform(lines))))
    for name in QUERIES:
        timed(name, lambda: run(queries[name](spark, SF_DIR)))

    numbers, texts, stamps = 8, 2, 1  # columns of lineitem by kind
    ceilings = {
        "table_fit_all": round(rows * (numbers * 1e-3 + texts * 1e-5 + stamps * 5e-6), 2),
        "table_transform_all": round(rows * (numbers * 5e-6 + texts * 1e-5 + stamps * 5e-6), 2),
        "table_reverse_all": round(rows * (numbers * 5e-6 + texts * 1e-5 + stamps * 5e-6), 2),
        "cat_reverse_nearest": round(rows * 1e-5, 2),
    }
    print(json.dumps({
        "metric": "total seconds of headline jobs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": CPUS, "rows": rows, "columns": columns,
        "rows_per_sec": {n: round(rows / t) for n, t in times.items() if n.startswith("table_")}, "ceilings": ceilings,
    }))


main()
